"""URL filter by rules and by a path-template tree.

Urls that a rule fits get its verdict, and serve as labels for the rest. Per host, path segments that vary become wildcards, level by level until
no path goes on; branches (templates that differ in their last literal only) whose labelled block rates don't differ statistically are merged. A
template's purity is its branch's block rate, smoothed towards the rate of the same template on all hosts (each host counts once), and that
towards ``prior_rate``; so a rule on one path says nothing of a host's other paths, and a template without labels anywhere isn't rejected.

Scale: everything works on distinct (host, path) with counts, pre-aggregated before each shuffle; no step needs a host's rows in one task. Tables
that a hot host's rows meet are aggregates, written before the join, so that they are broadcast where they are small and the hot partition is split
where they aren't. A path that shares its generalised prefix with no other is finished at once, so long paths don't add levels. DataFrame
functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .storage import remove, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Segments that are wildcards wherever they stand: those with a digit, and a literal star.
ALWAYS = "[0-9]|^[*]$"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    """More than ``max_branches`` distinct segments that are more than ``1/max_share`` of a node's pages count as variable, as does one that
    ALWAYS fits; ``z``: merging limit; ``prior``: pseudo-pages (and pseudo-hosts) that smooth, at ``prior_rate`` in the end; ``reject``: least purity."""

    max_branches: int = 8
    max_share: int = 10
    z: float = 1.96
    prior: float = 4.0
    prior_rate: float = 0.5
    reject: float = 0.8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    return F.regexp_extract(F.substring(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + F.lit(1), F.length(rest)), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(F.coalesce(url, F.lit("")), at + F.lit(3), F.length(F.coalesce(url, F.lit(""))))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule], value=lambda r: r.text) -> Column:
    """Of the rules that fit, the longest: a rule fits its host and all subdomains where the path starts with the rule's."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(value(r))) if found is None else found.when(fits, F.lit(value(r)))
    return F.lit(None).cast("string") if found is None else found.otherwise(F.lit(None).cast("string"))


def _generalised(segments: Column, k: Column, template: Column, family: Column) -> tuple[Column, Column]:
    """Template and family of a path that no other follows beyond its first k segments: only digits make a wildcard there."""
    rest = F.slice(segments, k + 1, F.greatest(F.lit(0), F.size(segments) - k))
    digit = lambda s: s.rlike(ALWAYS)
    template_ = F.concat(template, F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), F.when(digit(s), F.lit("*")).otherwise(s))), ""))
    # the family of the last literal, and a star for each wildcard behind it
    literals = F.filter(F.transform(rest, lambda s, i: F.when(~digit(s), i)), lambda i: i.isNotNull())
    last = F.array_max(literals)
    head = F.concat(template, F.array_join(F.transform(F.slice(rest, F.lit(1), last), lambda s: F.concat(F.lit("/"), F.when(digit(s), F.lit("*")).otherwise(s))), ""))
    named = F.concat(head, F.lit("/+"), F.repeat(F.lit("/*"), F.size(rest) - last - 1))
    family_ = F.when(last.isNotNull(), named).otherwise(F.concat(family, F.repeat(F.lit("/*"), F.size(rest))))
    return template_, family_


def templates(paths: DataFrame, settings: Settings) -> DataFrame:
    """Distinct rows (host, path, n, blocked) with ``template`` and ``family`` (the template with a plus for its last literal)."""
    spark, k = paths.sparkSession, 0
    open_ = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumns({"template": F.lit(""), "family": F.lit("")})
    done, last = [open_.where(F.size("segments") == 0).drop("segments")], []
    open_ = open_.where(F.size("segments") > 0)
    while True:
        here = F.get("segments", F.lit(k))
        branches = open_.groupBy("host", "template", here.alias("segment")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        nodes, at = written(branches.groupBy(F.col("host").alias("node_host"), F.col("template").alias("node")).agg(F.count("*").alias("branches"), F.sum("n").alias("pages"), F.sum("rows").alias("rows")), "url-nodes")
        met = open_.join(nodes, (F.col("host") == F.col("node_host")) & (F.col("template") == F.col("node")))
        varies = here.rlike(ALWAYS) | ((F.col("branches") > settings.max_branches) & (F.col("branches") * settings.max_share > F.col("pages")))
        alone = F.col("rows") == 1
        whole, kin = _generalised(F.col("segments"), F.lit(k), F.col("template"), F.col("family"))
        family = F.when(alone, kin).when(varies, F.concat("family", F.lit("/*"))).otherwise(F.concat("template", F.lit("/+")))
        template = F.when(alone, whole).otherwise(F.concat("template", F.lit("/"), F.when(varies, F.lit("*")).otherwise(here)))
        k += 1
        out = met.withColumns({"family": family, "template": template, "finished": alone | (F.size("segments") == k)})
        # else every level would compute those before it twice
        out, path = written(out.drop("node_host", "node", "branches", "pages", "rows"), "url-level")
        remove(spark, at)
        done.append(out.where("finished").drop("segments", "finished"))
        open_ = out.where("NOT finished").drop("finished")
        last.append(path)
        if open_.isEmpty():
            break
    tree = done[0]
    for part in done[1:]:
        tree = tree.union(part)
    tree, _ = written(tree, "url-tree")
    remove(spark, *last)
    return tree


def judged_paths(paths: DataFrame, settings: Settings) -> DataFrame:
    """``purity`` (the smoothed block rate) of every distinct (host, path, n, blocked): blocked is 1, 0 or, without a label, null."""
    m, base = F.lit(settings.prior), F.lit(settings.prior_rate)
    labelled = F.sum(F.when(F.col("blocked").isNotNull(), F.col("n")).otherwise(0))
    blocks = F.sum(F.when(F.col("blocked") == 1, F.col("n")).otherwise(0))
    tree = templates(paths, settings)
    branch, _ = written(tree.groupBy("host", "family", "template").agg(labelled.alias("b_n"), blocks.alias("b_k")), "url-branches")
    # the same template on all hosts
    common = branch.where("b_n > 0").groupBy("template").agg(F.sum(F.col("b_k") / F.col("b_n")).alias("t_k"), F.count("*").alias("t_n"))
    common, _ = written(common.select(F.col("template").alias("t"), ((F.col("t_k") + m * base) / (F.col("t_n") + m)).alias("rate")), "url-templates")
    family, _ = written(branch.where("b_n > 0").groupBy(F.col("host").alias("f_host"), F.col("family").alias("f")).agg(F.sum("b_n").alias("f_n"), F.sum("b_k").alias("f_k")), "url-families")
    same = (F.col("host") == F.col("f_host")) & (F.col("family") == F.col("f"))
    known = branch.where("b_n > 0").join(family, same)
    # a branch against its family's others
    rate, rest = (F.col("f_k") + 1.0) / (F.col("f_n") + 2.0), F.col("f_n") - F.col("b_n")
    apart = F.abs(F.col("b_k") / F.col("b_n") - (F.col("f_k") - F.col("b_k")) / rest) / F.sqrt(rate * (1.0 - rate) * (1.0 / F.col("b_n") + 1.0 / rest))
    known, _ = written(known.withColumn("merged", F.when(rest > 0, apart <= settings.z).otherwise(F.lit(True))).drop("f_host", "f", "f_n", "f_k"), "url-known")
    merged, _ = written(known.where("merged").groupBy(F.col("host").alias("f_host"), F.col("family").alias("f")).agg(F.sum("b_n").alias("p_n"), F.sum("b_k").alias("p_k")), "url-merged")
    own = known.join(merged, same, "left")
    n, k = F.when(F.col("merged"), F.col("p_n")).otherwise(F.col("b_n")), F.when(F.col("merged"), F.col("p_k")).otherwise(F.col("b_k"))
    own = own.select(F.col("host").alias("o_host"), F.col("template").alias("o"), n.alias("n"), k.alias("k"))
    rated = branch.select("host", "template").join(own, (F.col("host") == F.col("o_host")) & (F.col("template") == F.col("o")), "left").join(common, F.col("template") == F.col("t"), "left")
    zero = F.lit(0)
    purity = (F.coalesce("k", zero) + m * F.coalesce("rate", base)) / (F.coalesce("n", zero) + m)
    rated, _ = written(rated.select(F.col("host").alias("r_host"), F.col("template").alias("r"), F.round(purity, 9).alias("purity")), "url-rated")
    return tree.join(rated, (F.col("host") == F.col("r_host")) & (F.col("template") == F.col("r"))).select("host", "path", "template", "purity")


def judge(pages: DataFrame, rules: Sequence[Rule], settings: Settings = Settings(), url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict, template and purity (the last two null where a rule decides).

    ``keep``: the columns that stay (all but those named like a result where None). A null url, or one without ``://``, has an empty host and path
    and is judged like any other; an empty table gives no rows; repeated rows each get their row. A template that no rule's page has on any host
    has the prior's purity and is allowed.
    """
    own = ["host", "path", "rule", "verdict", "template", "purity"]
    kept = [c for c in pages.columns if c not in own] if keep is None else keep
    # the kept columns travel as one, so their names can't clash with any other
    rows = pages.select(F.struct(F.lit(0).alias("__"), *kept).alias("row"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("__by_rule", rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict))
    paths = rows.groupBy("host", "path", "__by_rule").agg(F.count("*").alias("n")).withColumn("blocked", F.when(F.col("__by_rule") == "block", 1).when(F.col("__by_rule") == "allow", 0))
    paths, _ = written(paths.drop("__by_rule"), "url-paths")
    open_ = judged_paths(paths, settings)
    open_ = open_.select(F.col("host").alias("j_host"), F.col("path").alias("j_path"), "template", "purity")
    match = F.col("rule").isNull() & (F.col("host") == F.col("j_host")) & (F.col("path") == F.col("j_path"))
    out = rows.join(open_, match, "left")
    by_method = F.when(F.col("purity") >= settings.reject, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("__by_rule", by_method)).select(*[F.col("row")[c].alias(c) for c in kept], *own)


def oracle(rules: Sequence[Rule], settings: Settings = Settings()) -> str:
    """DuckDB SQL for page_id, host, path, rule, verdict, template and purity (rounded) over ``pages``."""
    def fits(r: Rule) -> str:
        return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"

    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ordered)
    said = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)
    varies = f"(regexp_matches(seg[k + 1], '{ALWAYS}') OR (branches > {settings.max_branches} AND branches * {settings.max_share} > pages))"
    m, base = repr(float(settings.prior)), repr(float(settings.prior_rate))
    return f"""
WITH RECURSIVE r0 AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
r1 AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r0),
r AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM r1),
t AS (SELECT host, path, count(*) AS n, CASE said WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS blocked,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, '' AS family, '' AS template, 0 AS k FROM r GROUP BY host, path, said
  UNION ALL
  SELECT host, path, n, blocked, seg, CASE WHEN {varies} THEN family || '/*' ELSE template || '/+' END,
  template || '/' || CASE WHEN {varies} THEN '*' ELSE seg[k + 1] END, k + 1
  FROM (SELECT *, count(DISTINCT seg[k + 1]) OVER w AS branches, sum(n) OVER w AS pages FROM t WHERE len(seg) > k WINDOW w AS (PARTITION BY host, template))),
tree AS (SELECT * FROM t WHERE len(seg) = k),
b AS (SELECT host, family, template, sum(CASE WHEN blocked IS NOT NULL THEN n ELSE 0 END)::DOUBLE AS b_n, sum(CASE WHEN blocked = 1 THEN n ELSE 0 END)::DOUBLE AS b_k FROM tree GROUP BY ALL),
c AS (SELECT template, (sum(b_k / b_n) + {m} * {base}) / (count(*) + {m}) AS rate FROM b WHERE b_n > 0 GROUP BY template),
f AS (SELECT *, sum(b_n) OVER g AS f_n, sum(b_k) OVER g AS f_k, (f_k + 1) / (f_n + 2) AS fr FROM b WHERE b_n > 0 WINDOW g AS (PARTITION BY host, family)),
y AS (SELECT *, CASE WHEN f_n > b_n THEN abs(b_k / b_n - (f_k - b_k) / (f_n - b_n)) / sqrt(fr * (1 - fr) * (1 / b_n + 1 / (f_n - b_n))) <= {settings.z!r} ELSE true END AS merged FROM f),
o AS (SELECT host, template, CASE WHEN merged THEN sum(b_n) FILTER (merged) OVER g ELSE b_n END AS n, CASE WHEN merged THEN sum(b_k) FILTER (merged) OVER g ELSE b_k END AS k FROM y WINDOW g AS (PARTITION BY host, family)),
z AS (SELECT b.host, b.template, round((coalesce(k, 0) + {m} * coalesce(rate, {base})) / (coalesce(n, 0) + {m}), 9) AS purity
  FROM b LEFT JOIN o ON b.host = o.host AND b.template = o.template LEFT JOIN c ON b.template = c.template),
j AS (SELECT tree.host, tree.path, tree.template, z.purity FROM tree JOIN z ON tree.host = z.host AND tree.template = z.template)
SELECT page_id, r.host, r.path, rule, coalesce(said, CASE WHEN j.purity >= {settings.reject!r} THEN 'block' ELSE 'allow' END) AS verdict, j.template, j.purity
FROM r LEFT JOIN j ON r.rule IS NULL AND r.host = j.host AND r.path = j.path"""
