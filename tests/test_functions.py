"""Edge rows of the scalar functions, and Python checks of what SQL can't say."""

import zipfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import hashing, probs as P, text as T
from tallyspark.operators import augment, compare, decide, filters, joins, metrics, packing, policy, profiles, ranking, scoring
from tallyspark.sources import files
from tallyspark.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_probabilities(spark):
    assert one(spark, P.argmax(arr(0.4, 0.4, 0.2))) == 0
    assert one(spark, P.margin(arr(1.0))) == 1.0
    assert one(spark, P.entropy(arr(1.0))) == 0.0
    assert one(spark, P.confidence(arr(1.0))) == 1.0
    assert one(spark, P.over_labels(arr(0, 0, 1))) == [0.0, 0.0]
    assert abs(one(spark, P.nll(arr(0, 1), arr(1, 0))) - 27.631) < 1e-3
    assert one(spark, P.softmax(arr(1000, 0))) == [1.0, 0.0]
    assert abs(sum(one(spark, P.cumulative_link(F.lit(0.3), F.lit(-1.0), arr(0.1, 0.2)))) - 1) < 1e-12
    assert one(spark, P.jsd_maps(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("b"), F.lit(1.0)))) == 1.0


def test_summary_of_the_hand_rows(spark):
    rows = spark.createDataFrame([([0.7, 0.2, 0.1], [1.0, 0.0, 0.0], 0, 2), ([0.1, 0.1, 0.8], [0.0, 0.0, 1.0], -1, 2)], "probs array<double>, target array<double>, label int, k int")
    got = metrics.summarize(rows).first()
    assert round(got["nll"], 4) == 0.2899 and round(got["brier"], 4) == 0.10 and got["acc"] == 1 and got["acc_k"] == 1 and got["conf_wrong"] == 0


def test_auroc_edges(spark):
    rows = lambda data: spark.createDataFrame(data, "s double, y int")
    assert metrics.auroc(rows([(0.1, 1), (0.2, 1)]), "s", "y").first()["auroc"] is None
    assert metrics.auroc(rows([(0.5, 1), (0.5, 0)]), "s", "y").first()["auroc"] == 0.5
    assert metrics.auroc(rows([(0.9, 1), (0.1, 0)]), "s", "y").first()["auroc"] == 1.0


def test_calibration_bins(spark):
    assert one(spark, metrics.bin_equal(F.lit(1.0), 15)) == 14
    assert one(spark, metrics.bin_equal(F.lit(0.2), 15)) == 3
    assert one(spark, metrics.bin_floor(F.lit(1.0), 10)) == 9


@pytest.mark.parametrize(
    "text, want",
    [("mail bob@example.org now", "mail [email] now"), ("card 1234 5678 9012 3456", "card [card]"), ("call +49 170 123 4567", "call [phone]"), ("DE89 3704 0044 0532 0130 00", "[iban]"), ("plain", "plain")],
)
def test_masks(spark, text, want):
    assert one(spark, T.masked(F.lit(text))) == want


def test_text(spark):
    assert one(spark, T.value_norm(F.lit(" Sev-1 "))) == "sev 1"
    assert one(spark, T.value_norm(F.lit("+3.50"))) == "3.50"
    assert one(spark, T.value_norm(F.lit("--"))) == "--"
    assert one(spark, T.identifier_words(F.lit("CamelCaseName"))) == "camel case name"
    assert one(spark, T.identifier_words(F.lit("ALLCAPS"))) == "allcaps"
    assert one(spark, T.guessed_language(F.lit(""))) == "und"
    assert one(spark, T.norm_text(F.lit("A  b"))) == "a b"
    assert one(spark, T.near_variants(F.lit("x."))) == "x"
    assert one(spark, T.shingles(F.split(F.lit("a b"), " "), 3)) == []
    assert one(spark, files.nfkc_casefold(F.lit("Straße ﬁn")).alias("x")) == "strasse fin"


def test_hashes(spark):
    import hashlib

    for v in ("1", "abc", "42"):
        assert one(spark, hashing.digest_mod(F.lit(v), 10)) == int(hashlib.sha256(v.encode()).hexdigest(), 16) % 10
        assert one(spark, hashing.unit("s", F.lit(v))) == int(hashlib.md5(f"s:{v}".encode()).hexdigest()[:8], 16) / 2**32


PROGRAM = {"fields": ["a", "b"], "mode": "priority", "fallback": "no", "rules": [{"when": {"all": [{"field": "a"}, {"field": "b"}]}, "action": "yes"}]}


def test_policies(spark):
    p = policy.compile_policy(PROGRAM)
    assert policy.partition_signature(p) == "0,0,0,1"
    for bad in (
        {**PROGRAM, "fields": ["a"]}, {**PROGRAM, "mode": "x"}, {**PROGRAM, "fallback": None}, {**PROGRAM, "fields": ["a", "b", "c"]},
        {**PROGRAM, "rules": PROGRAM["rules"] * 2}, {**PROGRAM, "rules": [{"when": {"field": "z"}, "action": "yes"}]}, {**PROGRAM, "rules": [{"when": {"any": []}, "action": "y"}]},
    ):
        with pytest.raises(ValueError):
            policy.compile_policy(bad)
    rows = spark.createDataFrame([(1, [0.0, 0.0])], "k int, z array<double>")
    got = {r["primary"]: r["logp"] for r in policy.outcome_distribution(rows, p, "z", "k").collect()}
    assert abs(2.718281828 ** got["yes({})"] - 0.25) < 1e-6


def test_three_valued_rules():
    fact = lambda i: {"op": "fact", "id": i}
    env = {"t": ("boolean", None, True), "f": ("boolean", None, False), "c": policy.CONFLICT, "n": ("integer", "EUR", Fraction(3)), "m": ("integer", "USD", Fraction(3)), "z": ("integer", "EUR", Fraction(0))}
    run = lambda node: policy.three_valued(node, env)
    assert run({"op": "all", "args": [fact("f"), fact("x")]}) is False
    assert run({"op": "all", "args": [fact("t"), fact("x")]}) == policy.MISSING
    assert run({"op": "all", "args": [fact("f"), fact("c")]}) == policy.CONFLICT
    assert run({"op": "any", "args": [fact("t"), fact("x")]}) is True
    assert run({"op": "eq", "left": fact("n"), "right": fact("m")}) == policy.CONFLICT
    assert run({"op": "ratio", "numerator": fact("n"), "denominator": fact("z")}) == policy.CONFLICT
    assert run({"op": "ge", "left": fact("n"), "right": fact("z")}) is True
    assert run({"op": "count_true", "args": [fact("t"), fact("f")]})[2] == 1


def test_greedy_selections(spark):
    cases = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 9, 3, 4, 20])], "g string, k int, n int")
    got = packing.case_quota(cases, "g", "k", "n", 10, "s").collect()
    assert 0 < sum(r["size"] for r in got) <= 10 and all(r["k"] != 4 for r in got)
    assert ranking.merged_buckets([("a", 1), ("b", 5), ("c", 4)], 0.25) == [("a+b", 6), ("c", 4)]
    assert joins.match_greedily([(3, 0, 0), (5, 1, 0), (1, 0, 1), (0, 2, 2)]) == {1: 0, 0: 1}


def test_alignment_with_repeated_names(spark):
    left = spark.createDataFrame([(1, ["a", "b", "a"])], "k int, names array<string>")
    right = spark.createDataFrame([(1, ["b", "a", "a"], [1.0, 2.0, 3.0])], "k int, names array<string>, v array<double>")
    assert joins.aligned(left, right, "k", "names", "v").first()["v"] == [2.0, 1.0, 3.0]


def test_lookup_refuses_repeated_keys(spark):
    rows, twice = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, p int")
    with pytest.raises(Exception, match="several predictions"):
        joins.lookup(rows, twice, "k").collect()


def test_jaccard_pairs_against_all_pairs(spark):
    sets = {i: {(i * j + j) % 17 for j in range(1 + i % 5)} for i in range(20)}
    rows = spark.createDataFrame([(i, v, v, len(s)) for i, s in sets.items() for v in s], "k int, gram long, check int, n int")
    got = {(r["a"], r["b"]) for r in joins.jaccard_pairs(rows.withColumnRenamed("k", "a"), rows.withColumnRenamed("k", "b"), "a", "b", 0.5).collect()}
    assert got == {(i, j) for i, x in sets.items() for j, y in sets.items() if len(x & y) / len(x | y) >= 0.5}


def test_routing_takes_the_exact_number(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 6 else 0.5) for i in range(10)], "k int, s double")
    got = {r["k"] for r in ranking.routed(rows, "s", ["k"], 30).where("routed").collect()}
    assert got == {5, 4, 3}


def test_semantic_predicate(spark):
    decide.register(spark)
    assert spark.sql("SELECT semantic_prob('the parcel was late', 'Late parcel') AS p").first()["p"] == 1.0
    assert spark.sql("SELECT semantic_prob('x', '') AS p").first()["p"] == 0.0


def test_scorers(spark):
    rows = spark.createDataFrame([(1, "red car", "?", ["red", "blue"]), (2, "sea", "?", ["red", "blue"])], "k int, state string, query string, candidates array<string>")
    got = {r["k"]: r["pred"] for r in scoring.decide(rows, scoring.lexical()).collect()}
    assert got == {1: 0, 2: 2}
    with pytest.raises(Exception, match="without scores"):
        scoring.decide(rows, scoring.precomputed(spark.createDataFrame([(1, [0.0])], "k int, logits array<double>"), "k")).collect()


def test_mail_and_archives(spark, tmp_path):
    raw = b"From: Ann <ann@x.org>\nTo: bob@y.org\nSubject: Re: hi\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nMessage-ID: <1@x>\n\nhello\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(raw)
    (tmp_path / "in/b.mbox").write_bytes(b"From ann Mon Jan  1 10:00:00 2024\n" + raw + b"\n")
    with zipfile.ZipFile(tmp_path / "in/c.zip", "w") as z:
        z.writestr("m.eml", raw)
    got = files.read_mail(spark, str(tmp_path / "in")).collect()
    assert len(got) == 3 and {r["frm"] for r in got} == {"ann@x.org"} and {r["body"].strip() for r in got} == {"hello"}
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("votes.txt", "a\nb\n")
    assert [r["text"] for r in files.read_zip_lines(spark, str(tmp_path / "v.zip"), "votes.txt").orderBy("line").collect()] == ["a", "b"]


def test_publish_refuses_a_taken_place(spark, tmp_path):
    files.publish(spark.range(3), f"file://{tmp_path}/t")
    with pytest.raises(FileExistsError):
        files.publish(spark.range(3), f"file://{tmp_path}/t")


def test_leaves_and_violations(spark):
    rows = spark.createDataFrame([(1, '{"a": ["x", {"b": "y"}], "provenance": "z"}'), (2, "no json"), (3, None)], "k int, j string")
    assert {(r["path"], r["text"]) for r in files.string_leaves(rows, "k", "j", ["provenance"]).collect()} == {("a[0]", "x"), ("a[1].b", "y")}
    got = filters.violations(spark.createDataFrame([(1,), (None,)], "v int"), {"positive": F.col("v") > 0}).first()
    assert got["n"] == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g int, k int, s double, label int, text string")
    assert metrics.auroc(none, "s", "label").collect()[0]["auroc"] is None
    assert ranking.group_split(none, F.col("text"), 3, "s").count() == 0
    assert profiles.purity(none, "g", "k").count() == 1
    assert augment.rotated(none, ["g"], "k", "text").count() == 0
    assert compare.transitions(none, none, ["k"], "text").count() == 0


def test_stream_sessions_close(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 00:05:00'), (1, TIMESTAMP '2024-01-02 00:00:00'), (2, TIMESTAMP '2024-01-03 00:00:00') v(u, ts)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.sessions(ingest.file_stream(spark, str(tmp_path / "in"), "u int, ts timestamp"), "u", "ts", "1 hour", "1 minute")
    got = ingest.to_memory(s, "closed_sessions", str(tmp_path / "state")).collect()
    assert sorted((r["u"], r["n"]) for r in got) == [(1, 1), (1, 2)]


def test_sharing_pairs_agree_with_brute_force(spark):
    options = ["x", "y", "z", None]
    rows = [(i, None if i > 44 else "s" if i % 3 else "t", [options[i % 4], options[i // 4 % 4]]) for i in range(48)]
    got = sorted(map(tuple, joins.sharing_pairs(spark.createDataFrame(rows, "k long, s string, o array<string>"), "k", "s", "o").collect()))
    assert got == [(a, b) for a, s, x in rows for b, t, y in rows if a < b and s is not None and s == t and (set(x) & set(y)) - {None}]


def test_csv_rows_are_the_first_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k, v \n" + "".join(f"{k},{'x' * (k % 9)}\n" for k in range(9, 0, -1)))
    (tmp_path / "b.csv").write_text("k, v \n" + "".join(f"{k},{'x' * 5000}\n" for k in range(20, 9, -1)))  # larger, so read before
    assert [r["k"] for r in files.read_records_csv(spark, str(tmp_path), 12).collect()] == [*map(str, range(9, 0, -1)), "20", "19", "18"]
    assert [r["k"] for r in files.read_records_csv(spark, str(tmp_path), 11, F.col("k").cast("long")).collect()] == [*map(str, range(1, 12))]


def test_values_just_below_a_half_go_down(spark):
    from tallyspark.plans import catalog  # noqa: F401  (before its fixtures, which import it)
    from tallyspark.plans.fixtures import R, rounded

    assert 0.5000005 * 1e6 < 500000.5
    assert one(spark, R(F.lit(0.5000005))) == 0.5 and one(spark, R(F.lit(-2.5), 0)) == -3.0 and one(spark, R(F.lit(None).cast("double"))) is None
    assert one(spark, rounded(arr(0.5000005, 0.25))) == [0.5, 0.25]
