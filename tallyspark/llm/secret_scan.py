"""Secret scan: base patterns, and a battery of randomness tests over tokens that no pattern knows.

A token's encoding is inferred from its characters. Three tests ask whether it could be random in that encoding: chi-squared uniformity over
parts of the alphabet, the runs test about the alphabet's middle, and serial correlation. Random tokens have uniform p-values, other text has
small ones. So in each stratum of lengths the p-values above ``TRUSTED`` say how many random tokens there are, and the findings are the tokens
above the least p-value at which at most ``FALSE_DISCOVERY`` of the reported ones exceed that uniform share.

Scale: one map over the documents, whose spans are written, and a histogram of p-values with at most ``STRATA`` x ``BINS`` cells. No shuffle of texts
or tokens, so neither hot keys nor long documents meet in a task. Work in a text grows with n log n of its matches, but for running sums, which are
taken in chunks. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .storage import written

# The base patterns, and the least length of what they must find (the second group's for "assign").
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Tokens that are tested: this many characters of base64, url-safe base64 or a smaller alphabet, with padding.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: A tested token has letters and digits, or capitals behind small letters.
MIXED = r"[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z].*[a-z][A-Z]"
FALSE_DISCOVERY, TRUSTED = 0.05, 0.2
#: Lengths count in strata of powers of the square root of two; p-values in bins of equal width.
STRATA, BINS = 48, 100
#: Items of a running sum that are added one by one.
CHUNK = 256

# Alphabets by encoding, and the bounds of the parts whose counts are compared.
ALPHABETS = {
    "hex": ("0123456789abcdef", (4, 8, 12, 16)),
    "HEX": ("0123456789ABCDEF", (4, 8, 12, 16)),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (8, 16, 24, 32)),
    "alnum": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", (10, 23, 36, 49, 62)),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (13, 26, 39, 52, 64)),
}


def _bound(x: Column, f) -> Column:
    """f of x, which is evaluated once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(values: Column, combine) -> Column:
    """For each of an array's whole numbers, all before it combined (0 for the first). In chunks: a single fold that appends is quadratic."""
    kind = "struct<at:int,found:array<int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")).cast(kind)

    def fold(items):
        return F.aggregate(items, begin, lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")).cast(kind))

    def whole(xs):
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: fold(F.slice(xs, k * CHUNK + 1, CHUNK)))
        return _bound(chunks, lambda cs: F.flatten(F.zip_with(cs, fold(F.transform(cs, lambda c: c["at"]))["found"], lambda c, base: F.transform(c["found"], lambda v: combine(base, v)))))

    return _bound(values, whole)


def located(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, stop, value): code points, stop exclusive; the group has at least ``least`` characters.

    The text between the matches is what split() returns, so running sums of both lengths give the places.
    """
    kind = "array<struct<start:int,stop:int,value:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(found, F.length)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"), size.alias("size"))

    def placed(ps):
        begins = _running(F.transform(ps, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["value"]), F.lit(0))), lambda a, b: a + b)
        good = F.zip_with(ps, begins, lambda p, at: F.when(p["size"] >= least, _span(at + F.length(p["gap"]), p["value"])))
        return F.filter(good, lambda x: x.isNotNull())

    return F.when(text.rlike(pattern), _bound(parts, placed)).otherwise(F.array().cast(kind))


def _span(start: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"))


def _apart(tokens: Column, known: Column) -> Column:
    """The tokens that overlap none of the known spans: swept by place, a token begins behind every known span that starts before its end."""
    kind = "array<struct<at:int,rank:int,stop:int,token:struct<start:int,stop:int,value:string>>>"
    nothing = F.lit(None).cast("struct<start:int,stop:int,value:string>")
    ends = F.transform(tokens, lambda t: F.struct(t["stop"].alias("at"), F.lit(0).alias("rank"), F.lit(0).alias("stop"), t.alias("token"))).cast(kind)
    starts = F.transform(known, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("rank"), b["stop"].alias("stop"), nothing.alias("token"))).cast(kind)

    def swept(events):
        reach = _running(F.transform(events, lambda e: e["stop"]), F.greatest)
        free = F.zip_with(events, reach, lambda e, r: F.when(r <= e["token"]["start"], e["token"]))
        return F.filter(free, lambda t: t.isNotNull())

    return _bound(F.array_sort(F.concat(ends, starts)), swept)


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic curve (error below 0.0002)."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return 2.0 * _normal_tail(F.abs(z))


def _encoding(value: Column) -> Column:
    return (
        F.when(value.rlike("^[0-9a-f]+$"), "hex").when(value.rlike("^[0-9A-F]+$"), "HEX").when(value.rlike("^[A-Z2-7]+$"), "base32")
        .when(value.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")
    )


def _place_in(alphabet: str):
    return lambda c: F.call_function("instr", F.lit(alphabet), c) - 1


def _between(low: int, bound: int):
    return lambda v: (v >= low) & (v < bound)


def _numbered(value: Column, encoding: Column) -> Column:
    """The characters as places in the encoding's alphabet, from 0."""
    out = None
    for name, (alphabet, _) in ALPHABETS.items():
        chars = F.translate(value, "-_", "+/") if name == "base64" else value
        places = F.transform(F.split(chars, ""), _place_in(alphabet))
        out = F.when(encoding == name, places) if out is None else out.when(encoding == name, places)
    return F.filter(out, lambda x: x >= 0)


def tested(tokens: Column) -> Column:
    """Structs (start, stop, stratum, p): p is the battery's combined p-value of "random in its encoding", uniform for random tokens (Sidak)."""
    named = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.rtrim(t["value"], F.lit("=")).alias("value")))
    named = F.transform(named, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["value"].alias("value"), _encoding(t["value"]).alias("encoding")))

    def counted(t):
        return F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["encoding"].alias("encoding"), _numbered(t["value"], t["encoding"]).alias("x"))

    def summed(t):
        x, n = t["x"], F.size(t["x"]).cast("double")
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v, lambda a: a / n)
        size = F.lit(0)
        for name, (alphabet, _) in ALPHABETS.items():
            size = F.when(t["encoding"] == name, len(alphabet)).otherwise(size)
        high = F.transform(x, lambda v: (v * 2 >= size).cast("int"))
        return F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["encoding"].alias("encoding"), x.alias("x"), n.alias("n"), mean.alias("mean"), high.alias("high"))

    def figures(t):
        x, n, mean, high = t["x"], t["n"], t["mean"], t["high"]
        chi, freedom = F.lit(0.0), F.lit(1.0)
        for name, (alphabet, bounds) in ALPHABETS.items():
            total, low = F.lit(0.0), 0
            for bound in bounds:
                expected = n * ((bound - low) / len(alphabet))
                seen = F.size(F.filter(x, _between(low, bound)))
                total = total + (seen - expected) * (seen - expected) / expected
                low = bound
            chi = F.when(t["encoding"] == name, total).otherwise(chi)
            freedom = F.when(t["encoding"] == name, float(len(bounds) - 1)).otherwise(freedom)
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - mean) * (b - mean))
        serial = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)
        spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        turns = F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda a, b: (a != b).cast("int"))
        runs = F.aggregate(turns, F.lit(1), lambda a, v: a + v)
        ones = F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double")
        return F.struct(
            t["start"].alias("start"), t["stop"].alias("stop"), n.alias("n"), chi.alias("chi"), freedom.alias("freedom"),
            serial.alias("serial"), spread.alias("spread"), runs.cast("double").alias("runs"), ones.alias("ones"),
        )

    def combined(t):
        n, v = t["n"], 2.0 / (9.0 * t["freedom"])
        uniform = _normal_tail((F.pow(t["chi"] / t["freedom"], F.lit(1 / 3)) - (1.0 - v)) / F.sqrt(v))  # Wilson and Hilferty
        both = 2.0 * t["ones"] * (n - t["ones"])
        spread = both * (both - n) / (n * n * (n - 1.0))
        runs = F.when(spread > 0, _two_sided((t["runs"] - both / n - 1.0) / F.sqrt(spread))).otherwise(0.0)
        serial = F.when(t["spread"] > 0, _two_sided(t["serial"] / t["spread"] * F.sqrt(n))).otherwise(0.0)
        p = 1.0 - F.pow(1.0 - F.least(uniform, runs, serial), F.lit(3.0))
        stratum = F.least(F.lit(STRATA - 1), F.floor(2.0 * F.log2(F.greatest(n, F.lit(1.0)))).cast("int"))
        return F.struct(t["start"].alias("start"), t["stop"].alias("stop"), stratum.alias("stratum"), p.alias("p"))

    return F.transform(F.transform(F.transform(F.transform(named, counted), summed), figures), combined)


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(p * BINS).cast("int"))


def with_spans(rows: DataFrame, text: str) -> DataFrame:
    """Rows with __assign, __access, __hex (located matches) and __tested (tested tokens that touch none of them) instead of the text."""
    # long runs only: a maximal run is found at the same place with or without its least length in the pattern
    base = rows.withColumns({
        "__assign": located(F.col(text), ASSIGN, MIN_ASSIGN, 2),
        "__access": located(F.col(text), rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", MIN_ACCESS),
        "__hex": located(F.col(text), rf"[0-9a-f]{{{MIN_HEX},}}", MIN_HEX),
        "__tokens": located(F.col(text), TOKEN),
    })
    mixed = F.filter("__tokens", lambda t: t["value"].rlike(MIXED))
    known = F.concat("__assign", "__access", "__hex")
    fresh = F.when(F.size("__tokens") > 0, _apart(mixed, known)).otherwise(F.col("__tokens"))
    return base.withColumn("__tokens", fresh).withColumn("__tested", tested(F.col("__tokens"))).drop("__tokens")


def thresholds(rows: DataFrame) -> dict[int, int]:
    """By stratum, the least bin of p-values that are findings; strata without any are left out."""
    cells = rows.select(F.explode("__tested").alias("t")).groupBy(F.col("t.stratum").alias("stratum"), _bin(F.col("t.p")).alias("bin")).agg(F.count("*").alias("n"))
    above, all_ = W.partitionBy("stratum").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy("stratum")
    trusted = int(TRUSTED * BINS)
    random = F.sum(F.when(F.col("bin") >= trusted, F.col("n")).otherwise(0)).over(all_) / (1 - trusted / BINS)
    cells = cells.withColumns({"seen": F.sum("n").over(above), "random": random})
    wrong = F.col("seen") - F.col("random") * (1.0 - F.col("bin") / BINS)
    found = cells.where((F.col("random") > 0) & ((wrong <= FALSE_DISCOVERY * F.col("seen")) | (F.col("bin") >= trusted))).groupBy("stratum").agg(F.min("bin").alias("bin"))
    return {r["stratum"]: r["bin"] for r in found.collect()}  # at most STRATA rows


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but ``secrets`` where None) and ``secrets``: structs (start, kind, stop), by start and then by kind as listed in KINDS (kind is its number there).

    A null or empty text has no secrets; repeated rows each get their row; an empty table gives no rows. A column that is named ``secrets`` is
    replaced, all others stay. Texts are read once; what is kept of the rows is written with the spans.
    """
    kept = [c for c in docs.columns if c != "secrets"] if keep is None else keep
    # the kept columns travel as one, so their names can't clash with any other
    rows = docs.select(F.struct(F.lit(0).alias("__"), *kept).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows, _ = written(with_spans(rows, "__text").drop("__text"), "secret-spans")
    bounds = thresholds(rows.select("__tested"))
    limits = F.create_map(*[F.lit(v) for pair in bounds.items() for v in pair]) if bounds else F.create_map(F.lit(-1), F.lit(BINS))
    random = F.filter("__tested", lambda t: _bin(t["p"]) >= F.coalesce(F.try_element_at(limits, t["stratum"]), F.lit(BINS)))

    def as_spans(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))

    found = F.concat(as_spans(F.col("__assign"), 0), as_spans(F.col("__access"), 1), as_spans(F.col("__hex"), 2), as_spans(random, 3))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], F.array_sort(found).alias("secrets"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with each secret's span (overlapping ones as one) replaced by ``mark``; a null text stays null, all columns stay."""
    # the documents' columns travel as one, so their names can't clash with any other
    rows = scan(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text")), "text")
    kind = "array<struct<start:int,stop:int,at:int>>"

    def pieces(spans):
        """Spans with the furthest end before each; what lies between is kept. A chunk's part of the text is cut out once."""
        reach = _running(F.transform(spans, lambda s: s["stop"]), F.greatest)
        items = F.zip_with(spans, reach, lambda s, r: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), r.alias("at"))).cast(kind)

        def chunk(part):
            first = F.get(part, F.lit(0))["at"]
            last = F.array_max(F.transform(part, lambda s: F.greatest(s["start"], first)))
            return _bound(F.struct(F.substring(F.col("text"), first + 1, last - first).alias("text"), first.alias("first")), lambda cut: F.array_join(F.transform(part, lambda s: F.when(
                s["start"] >= s["at"], F.concat(F.substring(cut["text"], s["at"] - cut["first"] + 1, s["start"] - s["at"]), F.lit(mark))).otherwise("")), ""))

        return _bound(items, lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda k: _bound(F.slice(xs, k * CHUNK + 1, CHUNK), chunk)))

    end = F.array_max(F.transform("secrets", lambda s: s["stop"]))
    whole = F.concat(F.array_join(pieces(F.col("secrets")), ""), F.substring(F.col("text"), end + 1, F.length("text")))
    clean = F.when(F.size("secrets") > 0, whole).otherwise(F.col("text"))
    return rows.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
