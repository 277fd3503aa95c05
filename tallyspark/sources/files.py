"""Scans and sinks: JSON lines, split directories, CSV, archives of files, mailboxes, teacher files, sealed tables."""

from __future__ import annotations

import email
import email.policy
import email.utils
import io
import mailbox
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T

# The sizes that archive scans refuse.
MAX_MEMBER, MAX_MESSAGES = 64 << 20, 100_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); where that is unset, a temporary one if executors are this machine, else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and of a known size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By an explicit schema; blank lines give no rows. ``file`` is where a row came from, to resolve relative paths against."""
    return spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("file"))


def read_splits(spark: SparkSession, path: str, schema: str, cap: int | None = None, order: str | None = None) -> DataFrame:
    """``<path>/<name>.jsonl`` or ``<path>/<name>/*.jsonl`` as rows with eval_set = name, at most ``cap`` of each in the given order."""
    from pyspark.sql import Window as W

    rows = spark.read.option("recursiveFileLookup", True).schema(schema).json(path)
    rest = F.regexp_extract("_metadata.file_path", ".*/" + path.rstrip("/").rsplit("/", 1)[-1] + "/(.*)$", 1)
    rows = rows.select("*", F.regexp_replace(F.regexp_extract(rest, "^([^/]+)", 1), r"\.(jsonl|json|gz)$", "").alias("eval_set"))
    if cap is None:
        return rows
    return rows.withColumn("__r", F.row_number().over(W.partitionBy("eval_set").orderBy(order))).where(F.col("__r") <= cap).drop("__r")


def read_records_csv(spark: SparkSession, path: str, most: int | None = None, order: Column | None = None) -> DataFrame:
    """All columns as trimmed text, keys trimmed, unnamed columns dropped; every row, by ``order`` where it is given. With ``most`` only so many: the first by ``order``, else in the order of the files' names and of their rows."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = [c for c in raw.columns if c.strip(" ﻿") and not c.startswith("_c")]
    # a file with multiLine is read whole by one task, so the numbers of its rows grow
    rows = raw.select(*[T.strip(F.col(f"`{c}`").cast("string")).alias(c.strip(" ﻿")) for c in named], F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    by = ["__file", "__row"] if order is None else [order, "__file", "__row"]
    if most is not None:
        rows = rows.orderBy(*by).limit(most)
    elif order is not None:
        rows = rows.orderBy(*by)
    return rows.drop("__file", "__row")


def load_records(spark: SparkSession, source: dict) -> DataFrame:
    """Of ``kind`` csv, json, parquet or sample, as text columns; network kinds aren't read here."""
    kind = source["kind"]
    if kind == "csv":
        return read_records_csv(spark, source["path"])
    if kind in ("json", "parquet"):
        rows = spark.read.format(kind).load(source["path"])
    elif kind == "sample":
        from ..functions.hashing import rank_key

        rows = spark.read.parquet(source["path"])
        rows = rows.orderBy(rank_key(source.get("seed", "sample"), F.col(source["key"]))).limit(source["n"])
    else:
        raise ValueError(f"no source of kind {kind!r}")
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def read_zip_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(archive, line, text) of one member of zip archives; one task an archive, lines streamed."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if z.getinfo(member).file_size > MAX_MEMBER:
                        raise ValueError(f"{member} of {p} is too large")
                    text = z.read(member).decode("utf-8", "replace").splitlines()
                yield pd.DataFrame({"archive": p, "line": range(len(text)), "text": text})

    return files.mapInPandas(lines, "archive string, line int, text string")


def vote_shares(votes: DataFrame, keys: list[str], label: str, labels: list[str]) -> DataFrame:
    """Annotators' votes as a distribution over the labels for each key."""
    n = votes.where(F.col(label).isin(labels)).groupBy(*keys).agg(*[F.count_if(F.col(label) == v).alias(f"__{i}") for i, v in enumerate(labels)])
    total = sum((F.col(f"__{i}") for i in range(1, len(labels))), F.col("__0"))
    return n.select(*keys, F.array(*[F.col(f"__{i}") / total for i in range(len(labels))]).alias("dist"))


def parse_message(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    name, addr = email.utils.parseaddr(str(m.get("from", "")))
    when = email.utils.parsedate_to_datetime(m["date"]) if m["date"] else None
    body = m.get_body(("plain", "html"))
    return {
        "mid": str(m.get("message-id", "")), "ts": when.timestamp() if when else None, "frm": addr.lower(), "name": name, "rcpt": [a.lower() for _, a in email.utils.getaddresses([str(m.get("to", "")), str(m.get("cc", ""))])],
        "subject": str(m.get("subject", "")), "body": body.get_content() if body else "",
    }


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """Messages of .eml files, mbox files and zip archives of either: box, mid, ts, frm, name, rcpt, subject, body. One task a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def raws(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        if name.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.is_dir() and info.file_size <= MAX_MEMBER:
                        yield from raws(info.filename, z.read(info))
        elif content.startswith(b"From "):
            with tempfile.NamedTemporaryFile() as f:  # mailbox reads paths only; gone with the block
                f.write(content)
                f.flush()
                for m in mailbox.mbox(f.name):
                    yield name, m.as_bytes()
        else:
            yield name, content

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = [{"box": box.rsplit("/", 1)[-1], **parse_message(raw)} for box, raw in raws(p, content)][:MAX_MESSAGES]
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(parse, "box string, mid string, ts double, frm string, name string, rcpt array<string>, subject string, body string")


def clean_body(body: Column) -> Column:
    """The sender's own words: without quoted lines, cut at the first quote or forward marker or signature, blanks collapsed."""
    lines = F.filter(F.split(body, "\n"), lambda x: ~F.ltrim(x).startswith(">"))
    mark = F.transform(lines, lambda x: F.trim(x).rlike(r"(?i)^(-{2,} ?(original message|forwarded).*|on .* wrote:|--|_{5,})\s*$"))
    cut = F.array_position(mark, True)
    own = F.when(cut > 0, F.slice(lines, F.lit(1), (cut - 1).cast("int"))).otherwise(lines)
    return F.substring(T.strip(F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), "[ \t]+", " "), "\n{3,}", "\n\n")), 1, 1500)


def teacher_rows(wide: DataFrame, long: DataFrame) -> DataFrame:
    """Both shapes of teacher files, (qid, probs) and (qid, candidate, prob), as qid and a map."""
    rows = wide.select("qid", F.explode("probs").alias("candidate", "prob")).unionByName(long.select("qid", "candidate", "prob"))
    return rows.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("candidate", "prob")))).alias("probs"))


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON with sorted keys (of the top level; maps inside must be sorted by sorted_map)."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def sealed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows, and a sha256 that doesn't depend on their order (over the sorted 16-bit parts' digests)."""
    hashed = rows.select(F.sha2(canonical_json(columns).cast("binary"), 256).alias("h"))
    parts = hashed.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("d"), F.count("*").alias("n"))
    return parts.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), "").cast("binary"), 256).alias("sha256"))  # 65536 digests


def publish(df: DataFrame, path: str) -> None:
    """Written beside and renamed into place; fails if the place is taken."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(to):
        raise FileExistsError(path)
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    if files.exists(to) or not files.rename(jvm.org.apache.hadoop.fs.Path(draft), to):
        files.delete(jvm.org.apache.hadoop.fs.Path(draft), True)
        raise FileExistsError(path)


def adapted(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Rows (source, state, label) by specs: name, rows, text (an SQL expression), label (an SQL expression) and an optional cap by hash rank."""
    out = None
    for s in specs:
        rows = s["rows"].selectExpr(f"'{s['name']}' AS source", f"cast({s['text']} AS string) AS state", f"cast({s['label']} AS string) AS label")
        if s.get("cap"):
            rows = rows.orderBy(F.sha2(F.col("state").cast("binary"), 256)).limit(s["cap"])
        out = rows if out is None else out.unionByName(rows)
    return out


def string_leaves(rows: DataFrame, key: str, json: str, skip: list[str]) -> DataFrame:
    """(key, path, text) of all string leaves of JSON texts, outside the skipped top-level keys."""
    import json as J

    def leaves(x, path):
        if isinstance(x, str):
            yield path, x
        elif isinstance(x, dict):
            for k, v in x.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from leaves(v, f"{path}[{i}]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for k, s in zip(pdf[key], pdf[json]):
                try:
                    value = J.loads(s) if s else None
                except ValueError:
                    continue
                if isinstance(value, dict):
                    value = {a: b for a, b in value.items() if a not in skip}
                found += [(k, p, t) for p, t in leaves(value, "")]
            yield pd.DataFrame(found, columns=[key, "path", "text"])

    return rows.select(key, json).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, path string, text string")


def nfkc_casefold(text: Column | str) -> Column:
    """NFKC and casefold, then runs of letters and digits, one blank between: neither is a built-in, so batches go through Arrow."""

    @F.pandas_udf("string")
    def tokens(s: pd.Series) -> pd.Series:
        import re
        import unicodedata

        word = re.compile(r"[^\W_]+")
        return s.map(lambda x: None if x is None else " ".join(word.findall(unicodedata.normalize("NFKC", x).casefold())))

    return tokens(text)
