"""Each operator against a brute-force version on small fixtures, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import components, embedding_dedup, license_scan, media, mixing, packing, prefix, secret_scan, simhash_dedup, substring_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)]


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    shared = " ".join(draw.choice(VOCABULARY) for _ in range(80))
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(VOCABULARY) for _ in range(draw.randint(1, 200)))
        if i % 5 == 0:
            text = text + "\n" + shared + " tail"
        if i % 7 == 0:
            text = shared[: draw.randint(200, 400)] + " " + text
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(n, rows[3][1], "en", "s1", 1), (n + 1, rows[3][1], "en", None, 1), (n + 2, None, "en", "s2", 0), (n + 3, "", "en", "s2", 0), (n + 4, "É ß 漢字 \x1c\x85x", "en", "s0", 5), rows[5]]
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """With columns named like working columns and results."""
    return df.withColumns({c: F.lit(1) for c in ("size", "key", "spans", "labels", "score", "fp", "component_id", "toxicity", "host", "n_words", "secrets", "piece", "__text")})


# --- mixing


def test_mixing_takes_what_the_targets_say(spark, docs):
    sizes = mixing.counted(docs, ["doc_id", "source"])
    got = mixing.placed(sizes).collect()
    again = mixing.placed(sizes.repartition(5)).collect()
    key = lambda rows: Counter((r["doc_id"], tuple((p["copy"], p["words"]) for p in r["placements"])) for r in rows)
    assert key(got) == key(again)
    text = {r[0]: r[1] or "" for r in corpus()}
    assert all(r["size"] == len(WORD.findall(text[r["doc_id"]])) for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += sum(p["words"] for p in r["placements"])
        s[1] += r["size"]
        assert sum(p["words"] for p in r["placements"]) <= 3 * r["size"]
    total = sum(s[1] for s in by.values())
    assert all(abs(s[0] - s[2]) <= 0.5 and s[1] == s[3] and s[2] <= 3 * s[1] + 1e-6 for s in by.values())
    assert abs(sum(s[2] for s in by.values()) - min(total, 3 * total)) < 1e-6
    assert all(0 <= p["position"] <= 1 for r in got for p in r["placements"])


def test_mixing_caps_and_reshares():
    t = mixing.capped_targets({"a": 10, "b": 100, "c": 0}, {"a": 9, "b": 1, "c": 5}, 110, 3)
    assert t == {"a": 30.0, "b": 80.0, "c": 0.0}
    assert mixing.cyclic_weights([None, "b", "a"])[None].at(0.5) == 1


def test_curriculum_moves_a_source_later(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(200)], "doc_id long, source string, size long")
    plan = lambda names: {"a": mixing.Schedule((0, 1), (1, 0)), "b": mixing.Schedule((0, 1), (0, 1))}
    got = mixing.placed(rows, plan).collect()
    mean = {s: np.mean([p["position"] for r in got if r["source"] == s for p in r["placements"]]) for s in "ab"}
    assert mean["a"] < 0.4 < 0.6 < mean["b"]


def test_ordered_mix(spark, docs, empty):
    out = mixing.ordered_mix(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.ordered_mix(empty).count() == 0 and mixing.placed(mixing.counted(empty, ["doc_id", "source"])).count() == 0


# --- url filter

RULES = [url_filter.Rule(*r) for r in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"))]


def test_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/1", "http://a.example.com/en/2#t", "http://badexample.com/en/", "x://É.net/es/a://b", "http://h.net?x", "http://h.com", "http://h.org/a/b/c/d/e"]
    got = {r["i"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.text)
        assert got[i]["verdict"] in ("allow", "block") and (not best or got[i]["verdict"] == best.verdict)


def brute_purities(rows, n=url_filter.Settings()):
    """Of (host, path, n, blocked): (template, purity) by host and path, with a tree of Python dictionaries."""
    at = {(h, p): ("", "", [x for x in p.split("/") if x]) for h, p, _, _ in rows}
    pages, k = {(h, p): c for h, p, c, _ in rows}, 0
    while any(len(seg) > k for _, _, seg in at.values()):
        nodes = {}
        for (h, p), (t, _, seg) in at.items():
            if len(seg) > k:
                nodes.setdefault((h, t), []).append((seg[k], pages[h, p]))
        for (h, p), (t, f, seg) in list(at.items()):
            if len(seg) > k:
                here = nodes[h, t]
                kinds, total = len({s for s, _ in here}), sum(c for _, c in here)
                wild = bool(re.search("[0-9]", seg[k])) or seg[k] == "*" or kinds > n.max_branches and kinds * n.max_share > total
                at[h, p] = (f"{t}/*", f"{f}/*", seg) if wild else (f"{t}/{seg[k]}", f"{t}/+", seg)
        k += 1
    count = {}
    for h, p, c, blocked in rows:
        t, f, _ = at[h, p]
        x = count.setdefault((h, f, t), [0, 0])
        if blocked is not None:
            x[0], x[1] = x[0] + c, x[1] + c * blocked
    labelled = {key: v for key, v in count.items() if v[0]}
    rate = {}
    for t in {t for _, _, t in count}:
        votes = [v[1] / v[0] for (_, _, u), v in labelled.items() if u == t]
        rate[t] = (sum(votes) + n.prior * n.prior_rate) / (len(votes) + n.prior)

    def alike(key):
        h, f, _ = key
        total = [sum(v[i] for (a, b, _), v in labelled.items() if (a, b) == (h, f)) for i in (0, 1)]
        own, rest = labelled[key], total[0] - labelled[key][0]
        if not rest:
            return True
        mean = (total[1] + 1) / (total[0] + 2)
        return abs(own[1] / own[0] - (total[1] - own[1]) / rest) <= n.z * (mean * (1 - mean) * (1 / own[0] + 1 / rest)) ** 0.5

    merged = {key for key in labelled if alike(key)}
    out = {}
    for h, p, _, _ in rows:
        t, f, _ = at[h, p]
        key = (h, f, t)
        own = [sum(labelled[m][i] for m in merged if m[:2] == key[:2]) for i in (0, 1)] if key in merged else labelled.get(key, [0, 0])
        out[h, p] = t, round((own[1] + n.prior * rate[t]) / (own[0] + n.prior), 9)
    return out


def test_template_tree_against_dictionaries(spark):
    draw = random.Random(2)
    rows = {}
    for host in ("h.net", "g.com", "k.org", "", "deep.org"):
        for _ in range(60):
            path = "".join("/" + draw.choice(["en", "es", "x", "tag", f"{draw.randrange(99)}", "*", "+", f"v{draw.choice('abcdefghijklmnop')}"]) for _ in range(draw.randint(0, 5)))
            rows[host, path] = (host, path, draw.randint(1, 5), draw.choice([None, int("es" in path), int("es" in path), draw.randint(0, 1)]))
    rows["deep.org", "/q" * 40 + "/7"] = ("deep.org", "/q" * 40 + "/7", 1, 1)  # finished at once, though deep
    rows = list(rows.values())
    got = url_filter.judged_paths(spark.createDataFrame(rows, "host string, path string, n long, blocked int"), url_filter.Settings()).collect()
    assert {(r["host"], r["path"]): (r["template"], r["purity"]) for r in got} == brute_purities(rows) and len(got) == len(rows)


def test_templates_decide_by_their_own_labels(spark):
    pages = [f"http://a{h}.example.{tld}/{lang}/{i}" for h in range(8) for tld in ("com", "net", "org") for lang in ("en", "de", "es") for i in range(6)]
    pages += [pages[0]] * 3 + ["http://k.org" + "/a" * 3000]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), RULES).collect()
    assert len(got) == len(pages)
    said = {(r["host"], r["path"].split("/")[1]): r["verdict"] for r in got}
    # example.com/en/ is blocked, which other hosts' /en/ follows; their /de/ and, with labels of both kinds, /es/ don't
    assert said["a1.example.org", "en"] == "block" and said["a1.example.org", "de"] == said["a1.example.org", "es"] == "allow"
    assert said["a1.example.net", "es"] == "block" and said["a1.example.net", "de"] == "allow" and said["k.org", "a"] == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string"), RULES).count() == 0


# --- licences


def test_licenses_against_plain_search(spark, empty):
    texts = ["cc by cc by", "CC-BY and the General Public License, all rights reserved. All rights, reserved!", "", None, "gccby cc by-sa", "all rights reserved" * 3, "ÄCC BY", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception"]
    got = {r["i"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        hits = sorted((k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(hits))
        assert got[i]["first_word"] == (hits[0][0] if hits else None) and got[i]["last_word"] == (hits[-1][0] if hits else None)
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in hits})) and 0 <= got[i]["score"] <= 1
    assert got[7]["expressions"] == ["mit gpl-3.0-only or apache-2.0 llvm-exception with and"]
    assert license_scan.scan(empty).count() == 0


@pytest.mark.parametrize(
    "text, postfix",
    [("MIT", "mit"), ("MIT OR Apache-2.0 AND GPL-2.0+", "mit apache-2.0 gpl-2.0+ and or"), ("(MIT", "mit"), ("MIT OR", "mit"), ("MIT) AND X", "mit"), ("AND", None), ("", None), ("MIT prose follows", "mit"), ("((A OR B) AND C)", "a b or c and")],
)
def test_expressions(text, postfix):
    got = license_scan.parse_expression(text)
    assert (" ".join(got) if got else None) == postfix


# --- media


def test_media_round_trip(spark, docs, empty, tmp_path):
    got = media.described(media.stored(docs)).collect()
    want = Counter((r[0], hashlib.sha256(media.padded((r[1] or "").encode())).hexdigest()) for r in corpus())
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in got) == want
    assert len({r["media_sha256"] for r in got if r["payload_sha256"] == got[0]["payload_sha256"]}) == 1
    assert media.described(media.stored(empty)).count() == 0
    small = media.read_archives(spark, f"file://{tmp_path}")
    media.write_archives(spark.createDataFrame([(f"m{i}", bytes([i]) * 5000) for i in range(50)], "member string, payload binary").coalesce(1), f"file://{tmp_path}")
    small = media.read_archives(spark, f"file://{tmp_path}", rangeBytes="700")
    assert small.rdd.getNumPartitions() > 5 and sorted(r["member"] for r in small.collect()) == sorted(f"m{i}" for i in range(50))
    archive = next(tmp_path.glob("*.media"))
    offset = small.where("member = 'm7'").first()["offset"]
    raw = bytearray(archive.read_bytes())
    raw[offset + 45] ^= 255
    archive.write_bytes(raw)
    bad = media.read_archives(spark, f"file://{tmp_path}", onError="record", attempts="2").where("error IS NOT NULL").collect()
    assert [r["offset"] for r in bad] == [offset]
    with pytest.raises(Exception):
        media.read_archives(spark, f"file://{tmp_path}", attempts="1").collect()


def test_runs_of_members_are_read_at_once_and_failures_alone(tmp_path, monkeypatch):
    archive = media.Archive(f"file://{tmp_path}", "part-0")
    bodies = [media.encode_png(bytes([i]) * 192 * (1 + i % 3)) for i in range(200)]
    for i, body in enumerate(bodies):
        archive.add(f"m{i}", body)
    archive.close()
    monkeypatch.setattr(media, "INDEX_RECORDS", 16)
    files, reads = media._file_system(f"file://{tmp_path}")[0], []

    class Source:
        def __init__(self, path):
            self.source = files.open_input_file(path)
            reads.append("open")

        def read_at(self, n, offset):
            reads.append(n)
            if fails and n > 5000:
                raise OSError("lost")
            return self.source.read_at(n, offset)

        def close(self):
            self.source.close()

    class Files:
        def open_input_file(self, path):
            return Source(path)

        def __getattr__(self, name):
            return getattr(files, name)

    monkeypatch.setattr(media, "_file_system", lambda path: (Files(), path.removeprefix("file://")))
    for fails, most in ((False, 1), (True, 4)):
        for step in (1 << 30, 30_000):
            reads.clear()
            reader = media.ArchiveReader(f"file://{tmp_path}", step, 2, "fail")
            parts = reader.partitions()
            got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
            assert [(r["member"], r["media"]) for r in got] == [(f"m{i}", b) for i, b in enumerate(bodies)]
            assert reads.count("open") <= most * len(parts) and (fails or len(reads) < len(bodies))


def test_png_refuses_other_images():
    body = media.encode_png(b" " * 192)
    assert media.decode_png(body) == b" " * 192
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")
    with pytest.raises(ValueError):
        media.decode_png(body[:40] + b"\0" + body[41:])


# --- substring dedup


def brute_substring(rows, window):
    first, texts = {}, [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window", [8, 20, 50])
def test_substring_dedup_against_all_windows(docs, window):
    got = substring_dedup.deduplicated(docs, window, keep=["doc_id"]).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substring(corpus(), window)


def test_substring_dedup_of_repetitive_words(spark, empty):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 60))), "en", "s", 0) for i in range(40)] + [(40, "a " * 100, "en", "s", 0), (41, "a " * 90, "en", "s", 0)]
    got = substring_dedup.deduplicated(clashing(spark.createDataFrame(rows, DOCS)), 8, keep=["doc_id"]).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substring(rows, 8)
    assert substring_dedup.deduplicated(empty, 8).count() == 0


def test_nonbranching_paths_are_compacted(spark):
    """A passage that documents share becomes one path from its first word to its last, a fork ends it, and repeated rows and forks change no result."""
    passage = [f"p{i}" for i in range(400)]
    rows = [(i, " ".join([f"a{i}-{k}" for k in range(30)] + passage + [f"z{i}-{k}" for k in range(30)]), "en", "s", 0) for i in range(5)]
    rows += [(2, rows[2][1], "en", "s", 0), (7, " ".join(passage[:200] + [f"q{k}" for k in range(90)]), "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    spans = substring_dedup.repeats(df, 50).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").distinct().collect()
    assert all(r["source"] is not None for r in spans if r["stop"] - r["start"] > 50)
    of = {i: sorted((r["start"], r["stop"]) for r in spans if r["doc_id"] == i) for i in range(8)}
    longest = {i: max((b - a for a, b in of[i]), default=0) for i in of}
    assert not of[0] and of[1] == of[4] and min(longest[i] for i in (1, 2, 3, 4, 7)) > 120  # a single bucket's path is shorter than 93 words
    got = substring_dedup.deduplicated(df, 50, keep=["doc_id"]).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substring(rows, 50)


def test_a_span_that_differs_from_its_source_stays(spark, monkeypatch):
    """Digests of all paths made equal by force: words are compared at the source, so nothing unequal goes."""
    draw = random.Random(9)
    rows = [(i, " ".join(f"w{draw.randint(0, 9)}" for _ in range(8)), "en", "s", 0) for i in range(30)]

    def blind(raws, window, anchor, words):
        import numpy as np

        k, zero = np.arange(len(raws)), np.zeros(len(raws), dtype=np.int64)
        return k, zero, zero + 1, zero, zero, zero

    monkeypatch.setattr(substring_dedup, "paths_of", blind)
    got = substring_dedup.deduplicated(spark.createDataFrame(rows, DOCS), 8, keep=["doc_id"]).collect()
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(t, i)
    assert all(r["n_removed"] == 0 or texts[rows[r["doc_id"]][1]] < r["doc_id"] for r in got)


# --- SimHash


def fingerprint(text, width=3):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    least = dict.fromkeys(prints)
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(least)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_simhash_against_all_pairs(spark, docs, empty):
    prints = {r[0]: fingerprint(r[1]) for r in corpus()}
    got = simhash_dedup.grouped(docs).collect()
    assert all(r["fp"] & (1 << 64) - 1 == prints[r["doc_id"]] for r in got) and len(got) == len(corpus())
    want = brute_components(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert simhash_dedup.grouped(empty).count() == 0


@pytest.mark.parametrize("bucket", [2, 32])
def test_linked_fingerprints_in_dense_neighbourhoods(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    draw = random.Random(8)
    base = [draw.getrandbits(64) for _ in range(6)]
    prints = sorted({x ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 4))) & (1 << 64) - 1 for x in base for _ in range(25)})
    prints = [v - (1 << 64) if v >> 63 else v for v in prints]
    links = simhash_dedup.linked(spark.createDataFrame([(v,) for v in prints], "fp long")).collect()
    assert {(r["a"], r["b"]) for r in links} == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_near_copies_keep_one_of_each(spark, empty):
    draw = random.Random(3)
    rows = []
    for g in range(12):
        words = [draw.choice(VOCABULARY) for _ in range(300)]
        for c in range(4):
            edited = list(words)
            for _ in range(c):
                edited[draw.randrange(300)] = "new"
            rows.append((g * 10 + c, " ".join(edited), "en", "s", 0))
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, rows[0][1], "en", "s", 0), rows[0]]
    kept = sorted(r["doc_id"] for r in simhash_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == [g * 10 for g in range(12)] + [500]
    assert simhash_dedup.deduplicated(empty).count() == 0


def shingle_set(text, width=5):
    words = text.lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


@pytest.mark.parametrize("members", [4, 512])
def test_near_groups_against_exact_similarity(spark, monkeypatch, members):
    monkeypatch.setattr(simhash_dedup, "MEMBERS", members)
    draw = random.Random(11)
    rows, edits = [], 0
    for g in range(150):  # pairs from 0.7 to 0.9
        words = [f"g{g}w{draw.randrange(10**6)}" for _ in range(204)]
        edited = list(words)
        common = round((0.7 + 0.2 * g / 149) * 2 * 200 / (1.7 + 0.2 * g / 149))
        edited[common + 4 :] = [f"e{edits + k}" for k in range(200 - common)]
        edits += 1000
        rows += [(2 * g, " ".join(words), "en", "s", 0), (2 * g + 1, " ".join(edited), "en", "s", 0)]
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    exact = {g: len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(150)}
    assert min(exact.values()) < 0.72 and max(exact.values()) > 0.88
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i - 1 if i % 2 and exact[i // 2] >= 0.8 else i for i in sets}


def hashes_of(words, width=5):
    return [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]


def test_near_copies_without_a_common_least_hash_meet_in_the_pivot_tables(spark):
    for seed in range(50):
        draw = random.Random(seed)
        words = [f"x{draw.randrange(10**9)}" for _ in range(4000)]
        hashes = hashes_of(words)
        edited, least = list(words), sorted(hashes)[:8]
        for at in sorted(range(len(hashes)), key=hashes.__getitem__)[:4]:  # each of the four goes, and one below the eighth comes instead
            k = at + 2
            while True:
                edited[k] = f"y{draw.randrange(10**9)}"
                if min(hashes_of(edited[k - 4 : k + 5])) < least[4]:
                    break
        a, b = (np.unique(np.array(hashes_of(w), dtype="<u8")) for w in (words, edited))
        apart = (simhash_dedup.signature_of(a)[0] ^ simhash_dedup.signature_of(b)[0]) & (1 << 64) - 1
        if not set(a[:4].tolist()) & set(b[:4].tolist()) and apart.bit_count() <= 2:
            break
    else:
        raise AssertionError("no such pair")
    assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) > 0.98
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(edited), "en", "s", 0), (3, " ".join(words[::-1]), "en", "s", 0)]
    assert sorted(r["doc_id"] for r in simhash_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()) == [1, 3]


def test_near_copies_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "MEMBERS", 8)
    draw = random.Random(5)
    words = [draw.choice(VOCABULARY) for _ in range(400)]
    rows = [(i, " ".join([f"x{i}" if k == i % 400 else w for k, w in enumerate(words)]), "en", "s", 0) for i in range(60)]
    assert [r["doc_id"] for r in simhash_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()] == [0]


def test_components_split_a_hot_vertex(spark):
    """Its edges meet a written table of minima, so Spark splits them; beside an aggregate of the same exchange it wouldn't."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = 40_000
        ids = spark.range(n)
        edges = ids.where("id < 20000").selectExpr("0 AS a", "id + 1 AS b").union(ids.where("id >= 20000").selectExpr("id + 100000 AS a", "id + 300000 AS b"))
        edges, _ = components.written(edges.repartition(8), "edges")
        stars, _ = components._large_star(edges)
        stars.collect()
        assert "skew=true" in stars._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- toxicity


def test_gradient_of_the_network():
    draw = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial().items()}
    x = draw.normal(size=(5, 3, toxicity.INPUTS))
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    _, g = toxicity.gradients(p, x, mask, y, w)
    for name in p:
        i = tuple(draw.integers(n) for n in p[name].shape)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][i] += 1e-3
        down[name][i] -= 1e-3
        slope = (toxicity.gradients(up, x, mask, y, w)[0] - toxicity.gradients(down, x, mask, y, w)[0]) / 2e-3
        assert abs(slope - g[name][i]) < 2e-3, name
    for i in ((0, 0, 0), (4, 2, 5), (2, 1, 12)):
        up, down = x.copy(), x.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        slope = (toxicity.gradients(p, up, mask, y, w)[0] - toxicity.gradients(p, down, mask, y, w)[0]) / 2e-3
        assert abs(slope - g["x"][i]) < 1e-4


def test_gradient_of_the_embeddings():
    draw = np.random.default_rng(1)
    net = toxicity.Network(*(draw.normal(size=(1 << toxicity.HASH_BITS, toxicity.DEPTH)) for _ in range(2)), toxicity.initial())
    words = [b"a", b"idiot", "für".encode(), b"idiots"]
    part = toxicity._word_hash(words), *toxicity._grams(words)
    assert [int(n) for n in np.diff(np.append(part[2], len(part[1])))] == [1, 5 + 3, 4 + 2, 6 + 4]
    d = draw.normal(size=(4, toxicity.INPUTS))
    for table, found in zip((net.words, net.grams), net.embedding_gradients(d, *part)):
        for row in {int(part[0][1]), int(part[1][0]), int(part[1][7])}:
            before, slopes = table[row, 1], []
            for step in (1e-4, -1e-4):
                table[row, 1] = before + step
                slopes.append((net.embedded(*part).astype(np.float64) * d).sum())
            table[row, 1] = before
            assert abs((slopes[0] - slopes[1]) / 2e-4 - found[row, 1]) < 2e-2


def test_scores_are_those_of_single_windows():
    rows = toxic_corpus(120)
    net = toxicity.train([toxicity.windows_of(t) for _, t, _ in rows], [y for _, _, y in rows])
    texts = [t for _, t, _ in rows[:30]] + ["", "one", " ".join(t for _, t, _ in rows[:20])]
    want = []
    for text in texts:
        words, logits = toxicity.words_of(text), []
        for start in toxicity.window_starts(len(words)):
            window = words[start : start + toxicity.WINDOW]
            x = np.zeros((toxicity.WINDOW, 1, toxicity.INPUTS), np.float32)
            x[: len(window), 0] = net.inputs(window)
            mask = (np.arange(toxicity.WINDOW) < len(window)).astype(np.float32)[:, None]
            logits.append(float(toxicity.forward(net.params, *net.gates(x), mask)[0][0]))
        want.append(1 / (1 + np.exp(-(max(logits) - net.shift))))
    assert np.allclose(toxicity.Scorer(net).scores(texts), want, atol=1e-5)


def test_training_takes_long_texts_and_repeated_rows(spark):
    rows = [(i, t, "en", "s", 0) for i, t, _ in toxic_corpus(120)]
    rows += [(1, rows[4][1], "en", "s", 0)] * 3 + [(500, " ".join(["plain"] * 60_000 + ["vile"] * 40), "en", "s", 0)]
    labels = [(i, y) for i, _, y in toxic_corpus(120)] + [(1, 0), (1, 1), (500, 1)]
    assert len(toxicity.windows_of(rows[-1][1])) == toxicity.MAX_WINDOWS and toxicity.windows_of(rows[-1][1])[-1].endswith("vile")
    net = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.Scorer(net).scores(["w1 vile w2 nasty w3"])[0] > toxicity.Scorer(net).scores(["w1 w2 w3"])[0]


def test_training_takes_every_window(spark):
    draw, rows, labels = random.Random(8), [], []
    for i in range(60):  # the telling word is where none of 32 windows dealt evenly over the text would see it
        words = [draw.choice(VOCABULARY) for _ in range(3200)]
        if i % 2:
            words[70] = "vile"
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, i % 2))
    assert not any("vile" in w for _, t, *_ in rows for w in toxicity.windows_of(t))
    net = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    toxic, clean = toxicity.Scorer(net).scores(["w1 w2 vile w3 w4", "w1 w2 w3 w4"])
    assert toxic >= 0.5 > clean


def toxic_corpus(n=400):
    draw, rows = random.Random(2), []
    for i in range(n):
        words = [draw.choice(VOCABULARY) for _ in range(draw.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["nasty", "vile"]) + draw.choice(["", "est", "ly"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out_documents(spark, empty):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows] + [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0)], DOCS)
    net = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(docs, net).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows) + 2
    assert {r["doc_id"] for r in toxicity.accepted(docs, net).collect()} == {i for i, s in got.items() if s < 0.5}
    assert toxicity.scored(empty, net).count() == 0
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r["toxicity"] for r in toxicity.scored(docs, one).collect()} == {0.5}
    assert toxicity.accepted(docs, one).count() == docs.count()


def test_windows_cover_everything():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        covered = {k for s in toxicity.window_starts(n) for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


# --- packing


def test_other_steps_drop_the_encoder_that_a_worker_kept(docs, monkeypatch):
    import public_tokenizers

    runs, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or real(self, run, schema))
    toxicity.scored(docs, toxicity.train([["a b"]], [0]))
    packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert packing._encoders and list(runs[0](iter([]))) == [] and not packing._encoders



@pytest.mark.parametrize("part", [2, 4096])
def test_running_sums_over_parts(spark, part, monkeypatch):
    monkeypatch.setattr(prefix, "PART", part)
    draw = random.Random(4)
    rows = [(g, b, draw.randint(0, 9)) for g in ("a", "b", None) for b in range(0, 20) if draw.random() < 0.7]
    got = {(r["g"], r["b"]): r["before"] for r in prefix.running(spark.createDataFrame(rows, "g string, b long, v long"), ["g"], "b", "v").collect()}
    assert got == {(g, b): sum(v for h, c, v in rows if h == g and c < b) for g, b, _ in rows}


def test_repeated_rows_have_places_of_their_own(spark):
    docs = [(i % 3, f"one two three {'x ' * (i % 2)}", "en", "s", i) for i in range(40)] + [(100 + i, "four five", "en", "t", 0) for i in range(200)]
    out = [tuple(r) for r in mixing.ordered_mix(spark.createDataFrame(docs, DOCS)).collect()]
    plan = mixing.placed(mixing.counted(spark.createDataFrame(docs, DOCS), ["doc_id", "source"]), whole=True).collect()
    assert Counter(len(x[1].split()) for x in out if x[3] == "s") == Counter(r["size"] for r in plan for _ in r["placements"] if r["source"] == "s")
    # every one of the forty has its own number, so all are taken equally often, within one
    taken = Counter(x[4] for x in out if x[3] == "s")
    assert len(taken) == 40 and max(taken.values()) - min(taken.values()) <= 1


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_is_whole_and_gapless(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.packed(docs, tokenizer_path(), 64).collect()
    want = Counter()
    for i, text, *_ in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 64)):
            want[i, k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 64
    assert len(by) <= 1.1 * sum(k[3] * v for k, v in want.items()) / 64 + 1
    assert packing.packed(empty, tokenizer_path(), 64).count() == 0


def test_plan_places_every_rank_once():
    draw = random.Random(1)
    for _ in range(30):
        hist = {draw.randint(1, 50): draw.randint(1, 40) for _ in range(12)}
        seen, load = Counter(), {}
        for length, lo, hi, first, each, offset in packing.best_fit_plan(hist, 50):
            for rank in range(lo, hi):
                seen[length, rank] += 1
                load.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
        assert seen == Counter({(n, k): 1 for n, c in hist.items() for k in range(c)})
        for parts in load.values():
            end = 0
            for a, n in sorted(parts):
                assert a == end
                end += n
            assert end <= 50


@pytest.mark.parametrize("text", ["", "  ", "It's <|endoftext|> áb", "don't!!! ...a b..c", "x\x1cy\tz\r\n", "９９ abc123 x_y [z]", "ſ K Å µ İ Σ", "naïve's ça,,, ÀÉ''s", "漢字 hello漢"])
def test_encoder_equals_the_tokenizer(text):
    e = packing.encoder(tokenizer_path())
    got = np.frombuffer(next(iter(e.encode_all([text]))), dtype="<u4").tolist()
    assert got == e.tokenizer.encode(text, add_special_tokens=False).ids


# --- secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_against_plain_search(spark, empty):
    draw = random.Random(6)
    token = lambda n: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [
        None, "", "Token = 'abcdef' token:abc", "token=token:abcdefgh", "😀 api_key: 12345678 é AKIA" + "A" * 16, "AKIAAKIA" + "B" * 9, "f" * 23 + " " + "0a" * 20, "secret=secret=secret=1", "x" * 5000 + " PASSWD=hunter22",
        *[f"see {token(40)} here" for _ in range(30)], *["theandofthatwordword1word2word3" + " plain" * 3 for _ in range(5)], "11111111112222222222aaaaaaaaaa",
    ]
    got = {r["i"]: [tuple(s) for s in r["secrets"]] for r in secret_scan.scan(clashing(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 3] == base_spans(t or ""), t
    found = [bool([s for s in got[i] if s[1] == 3]) for i in range(9, 39)]
    assert sum(found) >= 24 and not any(s[1] == 3 for i in range(39, 45) for s in got[i])
    assert secret_scan.scan(empty).count() == 0


def test_random_tokens_among_identifiers(spark):
    """Few random tokens of several encodings and lengths among many names of code: both precision and recall."""
    draw = random.Random(1)
    words = "get set user account name list value index record table store parse build config handle request server client data file path load save update".split()
    join = [lambda w: w[0] + "".join(x.title() for x in w[1:]) + "7", lambda w: "_".join(w) + "_v2", lambda w: "-".join(w) + "-2024", lambda w: "/".join(w) + "/31"]
    rows, truth = [], set()
    for i in range(2500):
        if random_ := draw.random() < 0.06:
            alphabet = secret_scan.ALPHABETS[draw.choice(["base32", "alnum", "base64"])][0]
            token = "".join(draw.choice(alphabet) for _ in range(draw.choice([20, 32, 40, 64])))
            truth.add((i, 5, 5 + len(token)))
        else:
            token = draw.choice(join)([draw.choice(words) for _ in range(draw.randint(4, 8))])
        rows.append((i, f"here {token} there"))
    got = {(r["i"], s["start"], s["stop"]) for r in secret_scan.scan(spark.createDataFrame(rows, "i int, text string")).collect() for s in r["secrets"] if s["kind"] == 3}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.85 * len(got), (len(got & truth), len(got), len(truth))


def test_a_text_with_very_many_matches(spark):
    text = "token=abcdefg0, é\n" * 30_000 + "password: " + "0a" * 20 + " end"
    got = secret_scan.scan(spark.createDataFrame([(text,)], "text string")).first()["secrets"]
    assert [tuple(s) for s in got] == base_spans(text)
    clean = secret_scan.redacted(spark.createDataFrame([(text,)], "text string")).first()["text"]
    assert clean == "[secret], é\n" * 30_000 + "[secret] end"


def test_redaction(spark):
    rows = spark.createDataFrame([(0, "a token=abcdef12 b"), (1, None), (2, "clean"), (3, "secret: " + "0a" * 20)], "i int, text string")
    got = {r["i"]: r["text"] for r in secret_scan.redacted(rows).collect()}
    assert got == {0: "a [secret] b", 1: None, 2: "clean", 3: "[secret]"}


# --- embeddings


def brute_embeddings(rows, cosine=0.9):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=float)
            a = a / np.abs(a).max()
            good[i] = a / np.linalg.norm(a)
    ids = sorted(good)
    parent, links = {i: i for i, _ in rows}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i), root(i) == i) for i, _ in rows}


@pytest.mark.parametrize("block", [4, 2048])
def test_embeddings_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + draw.normal(size=8) * 0.25).astype(np.float32).tolist()) for i in range(90)]
    rows += [(200, rows[4][1]), (201, [2 * x for x in rows[4][1]]), (202, None), (203, [0.0] * 8), (204, [float("nan")] * 8), (205, [None] * 8), (206, [1.0] * 4), (207, [1.0] * 4), (208, [float("inf")] * 8), (209, [])]
    got = embedding_dedup.grouped(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == brute_embeddings(rows)


def test_no_embeddings(spark):
    assert embedding_dedup.grouped(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    none = embedding_dedup.grouped(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in none] == [(1, 0, 1, True)]
