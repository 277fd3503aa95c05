"""Text scalars: normalisers, renderers, masks and detectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns, word lists and scales whose results must agree with those of the decision data.
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}\b"
PHONE = r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|\+\d{10,15}\b"
PII = {"email": EMAIL, "iban": IBAN, "card": CARD, "phone": PHONE}
STOPWORDS = {
    "en": "the and to of in is it you that for on with this are was be have not",
    "es": "el la de que y en los del las por con para una un no se",
    "fr": "le la les de des et en un une est pour que dans pas ce qui sur",
    "de": "der die das und ist nicht ein eine zu den mit für auf ich sie",
}
SCRIPTS = {"he": "[\\u0590-\\u05FF]", "ar": "[\\u0600-\\u06FF]"}
QUESTION_WORDS = (
    "which what who whom when where why how should would could can will does did do is are was were be been "
    "the this that these those for with and you your our we they it its to of in on at by from any each"
)
SEVERITY_SCALE = ["none", "trivial", "minor", "low", "normal", "medium", "med", "moderate", "high", "major", "urgent", "severe", "critical", "blocker"]
NUMBER = r"^[-+]?\d+(?:\.\d+)?$"
YES, NO = ("yes", "y", "true"), ("no", "n", "false")


def strip(s: Column) -> Column:
    """Without white space at both ends (of any kind, not only blanks)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def trunc(s: Column, n: int = 1200) -> Column:
    return F.substring(strip(s), 1, n)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def norm_text(s: Column) -> Column:
    """Lower case, white space collapsed."""
    return collapse(F.lower(s))


def strict_norm(s: Column, numbers: bool = False) -> Column:
    """Lower case, punctuation as blanks and, with ``numbers``, digit runs as ``#``."""
    out = F.regexp_replace(F.lower(s), r"(?U)[^\w\s]", " ")
    return collapse(F.regexp_replace(out, r"\d+", "#") if numbers else out)


def value_norm(v: Column) -> Column:
    """A value's identity: numbers as written (without a leading plus), else lower case with punctuation as single blanks."""
    s = strip(v)
    words = F.trim(F.regexp_replace(F.lower(s), r"(?U)[\W_]+", " "))
    return F.when(s.rlike(NUMBER), F.regexp_replace(s, r"^\++", "")).when(words == "", F.lower(s)).otherwise(words)


def number_erased(s: Column) -> Column:
    numbered = F.regexp_replace(F.lower(s), r"\d+(?:\.\d+)?", "<number>")
    return F.array_join(F.regexp_extract_all(numbered, F.lit(r"(?U)[\w<>]+"), F.lit(0)), " ")


def identifier_words(name: Column) -> Column:
    """snake_case, CamelCase or ALLCAPS as lower-case words."""
    s = F.regexp_replace(name, r"[_./]", " ")
    plain = (F.instr(s, " ") > 0) | ((s == F.upper(s)) & (s != F.lower(s))) | ((s == F.lower(s)) & (s != F.upper(s)))
    return F.when(plain, F.lower(collapse(s))).otherwise(F.lower(F.regexp_replace(s, r"(?<!^)(?=[A-Z])", " ")))


def render(template: Column, **fields: Column) -> Column:
    """A template with ``{name}`` replaced."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def question_text(instructions: Column, kind: Column, keys: Column, values: Column) -> Column:
    """Instructions and a rubric line from criteria, given as arrays of keys (in order) and of descriptions (null: the key says it)."""
    said = F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit(": "), F.when((v == "") | v.isNull(), k).otherwise(v)))
    of = lambda key, default: F.coalesce(F.get(values, F.array_position(keys, key).cast("int") - 1), F.lit(default))
    noul = F.concat(F.lit("yes: "), of("true", "Yes"), F.lit("  no: "), of("false", "No"))
    listed = F.array_join(F.transform(values, lambda v, i: F.concat((i).cast("string"), F.lit(": "), v)), "  ")
    rubric = F.when(kind == "noul", noul).when(F.size(keys) == 0, listed).otherwise(F.array_join(said, "  "))
    return F.when(F.size(values) == 0, instructions).otherwise(F.concat(instructions, F.lit("\n"), rubric))


def masked(s: Column) -> Column:
    """Mail addresses, account numbers, cards and phones by their names, in this order."""
    for name, pattern in PII.items():
        s = F.regexp_replace(s, ("(?U)" if name == "email" else "") + pattern, f"[{name}]")
    return s


def guessed_language(text: Column) -> Column:
    """By the share of a script's letters, else by stop words (at least two, the first language on ties), else ``und``."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))
    letters = F.length(F.array_join(words, ""))
    hits = {c: F.size(F.filter(words, _is_one_of(s.split()))) for c, s in STOPWORDS.items()}
    best = F.greatest(*hits.values())
    out = F.when(F.size(words) == 0, "und")
    for code, pattern in SCRIPTS.items():
        out = out.when(F.regexp_count(text, F.lit(pattern)) > 0.3 * letters, code)
    for code, n in hits.items():
        out = out.when((n == best) & (best >= 2), code)
    return out.otherwise("und")


def _is_one_of(known: list[str]):
    return lambda w: w.isin(known)


def subject_key(s: Column) -> Column:
    """A subject without repeated reply and forward prefixes."""
    key = F.lower(collapse(F.regexp_replace(s, r"(?i)^\s*((re|fw|fwd|aw|sv|tr|wg)\s*(\[\d+\])?\s*:\s*)+", "")))
    return F.when(key.isin("(no subject)", "no subject"), "").otherwise(key)


def accounts_redacted(s: Column) -> Column:
    """Runs of eight and more digits (dashes allowed inside)."""
    return F.regexp_replace(s, r"\d(?:-?\d){7,}", "[number]")


def option_prefix_stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s*\(?[A-Za-z][.)]\s*", "")


def near_variants(s: Column) -> Column:
    """A surface variant: final period, leading article, or case swapped; the first that changes the string, in this order."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    s = F.regexp_replace(s, r"\s+$", "")
    period = F.when(s.endswith("."), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(F.concat(s, F.lit(".")))
    return F.when(period != s, period).otherwise(F.translate(s, lower + upper, upper + lower))


def article_variant(s: Column) -> Column:
    return F.when(F.lower(F.substring(s, 1, 4)) == "the ", s).otherwise(F.concat(F.lit("The "), F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))


def stems(s: Column) -> Column:
    """Distinct content words cut to five letters."""
    words = F.regexp_extract_all(value_norm(s), F.lit(r"(?U)[^\W\d_]{3,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(QUESTION_WORDS.split())), lambda w: F.substring(w, 1, 5))))


def id_tokens(s: Column) -> Column:
    """Identifier-like tokens: eight and more characters with a letter and a digit, mail addresses or dotted hosts."""
    tokens = F.regexp_extract_all(F.lower(s), F.lit(r"[\w.@\\/:-]+"), F.lit(0))
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.:/-]+|[.:/-]+$", ""))
    mixed = lambda t: t.rlike(r"[a-z]") & t.rlike(r"\d")
    dated = lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 8) & (mixed(t) | t.contains("@") | t.rlike(r"[a-z]\.[a-z]")) & ~dated(t))))


def lettered_options(options: Column) -> Column:
    """``A. first`` and so on, a line each."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def option_spans(options: Column) -> Column:
    """Where each option's line starts in lettered_options."""
    return F.transform(options, lambda o, i: F.aggregate(F.slice(options, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 4))


def is_yes_no(options: Column, qtype: Column | None = None) -> Column:
    """The options are yes and no, in any case and spacing, or two options of a noul question however they are spelled."""
    named = F.array_sort(F.array_distinct(F.transform(options, lambda o: F.lower(strip(o))))) == F.array(F.lit("no"), F.lit("yes"))
    return named if qtype is None else named | (F.coalesce(qtype == "noul", F.lit(False)) & (F.size(options) == 2))


def first_yes(options: Column) -> Column:
    """The place of the first literal yes, 0 when there is none."""
    return F.greatest(F.lit(0).cast("long"), F.array_position(F.transform(options, lambda o: F.lower(strip(o))), "yes") - 1)


def question_kind(s: Column) -> Column:
    """noul, score or choice of a question in words."""
    t = F.lower(strip(s))
    return (
        F.when(t.rlike(r"^(how (much|likely|urgent|severe|many)|rate|score)\b"), "score")
        .when(t.rlike(r"[:(].*[,/|].*\S"), "choice").when(t.rlike(r"\bor\b.*\?"), "choice")
        .when(t.rlike(r"^(is|are|was|were|do|does|did|can|could|should|will|would|has|have)\b"), "noul").otherwise("noul")
    )


def shingles(words: Column, n: int) -> Column:
    """Runs of n words; none when there are fewer."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def shingle_hashes(words: Column, n: int) -> Column:
    """Distinct runs of n words as structs (gram, check): 64 bits, checked by another 32; no run is built as text."""
    # array_distinct compares structs with each other, all with all
    first = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) != x))

    def hashed(w):
        places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(F.transform(places, lambda i: F.slice(w, i, n)), lambda run: F.struct(F.xxhash64(run).alias("gram"), F.hash(run).alias("check")))
        return F.get(F.transform(F.array(F.sort_array(runs)), first), F.lit(0))

    # words as a lambda's variable: filters that Spark infers put the whole expression in, and would split the text again for each run
    return F.get(F.transform(F.array(words), hashed), F.lit(0))


def case_text(facts: Column, body: Column) -> Column:
    """Fact lines, then body parts, blank lines between; empty parts are left out."""
    lines = F.array_join(F.filter(facts, lambda x: x != ""), "\n")
    return F.array_join(F.filter(F.array(lines, body), lambda x: x.isNotNull() & (x != "")), "\n\n")
