"""Secret scans with an incremental blob ledger.

Every text is a version of a path (doc_id) and is addressed by its SHA-256.  The
ledger holds the (blob, rule version) pairs that were ever scanned, with their
findings.  A run scans only pairs that the ledger lacks, once per blob however
many paths hold it, appends them, and joins findings back to all paths.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm.shared import column, shared_dir

# kind -> (version, pattern, group whose length counts, least length); in report order
RULES: dict[str, tuple[int, str, int, int]] = {
    "assign": (1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (1, r"[0-9a-f]+", 0, 24),
    "pem": (1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    "bearer": (1, r"(?ai:bearer)\x20+[A-Za-z0-9+/_.=-]+", 0, 27),
}
# for redaction: a private key goes up to its END line, or over the base64 lines after its BEGIN line
PEM_HEAD = r"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----"
PEM_GAP, PEM_END = r"(?:\s|\\[nr])+", r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)"
WHOLE_RULES = RULES | {"pem": (
    2, rf"{PEM_HEAD}(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1-----|(?:{PEM_GAP}(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/]{{16,}}={{0,2}}))*(?:[\r\n]+{PEM_END}(?=\s*(?:\Z|[\r\n])))?)", 0, 1)}
BASE_KINDS = ("assign", "access", "hex")
SPAN = "array<struct<start:long,end:long>>"


def find(text: str, rules: dict) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind: leftmost non-overlapping matches that are long enough."""
    out = {}
    for kind, (_, pattern, group, least) in rules.items():
        if kind == "hex":  # the same runs, without a match for each short one
            pattern = rf"(?<![0-9a-f])[0-9a-f]{{{least},}}"
        if kind == "access" and "AKIA" not in text or kind == "pem" and "-----BEGIN" not in text:
            continue
        spans = [m.span() for m in re.compile(pattern).finditer(text) if m.end(group) - m.start(group) >= least]
        if spans:
            out[kind] = spans
    return out


def _scan(texts: DataFrame, rules: dict) -> DataFrame:
    """(blob, kind, version, spans): a row for every blob and rule, also without findings."""

    def run(batches):
        for batch in batches:
            blob, kinds, versions, spans = [], [], [], []
            for sha, todo, text in zip(column(batch, "blob").to_pylist(), column(batch, "todo").to_pylist(), column(batch, "text").to_pylist()):
                found = find(text or "", {k: rules[k] for k in todo})
                for k in todo:
                    blob.append(sha)
                    kinds.append(k)
                    versions.append(rules[k][0])
                    spans.append([{"start": a, "end": b} for a, b in found.get(k, ())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blob, pa.binary()), pa.array(kinds, pa.string()), pa.array(versions, pa.int32()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["blob", "kind", "version", "spans"])

    return texts.mapInArrow(run, f"blob binary, kind string, version int, spans {SPAN}")


LEDGER = f"blob binary, kind string, version int, spans {SPAN}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: str | None = None, rules: dict | None = None) -> DataFrame:
    """(doc_id, blob, kinds): one row per row of ``docs``; kinds maps a kind to its spans, kinds without findings left out.

    ``ledger`` is a Parquet folder that all executors share; it is created at the
    first run and appended to.  None is a ledger of this run alone.  A null text is
    empty, and empty texts have no findings; repeated rows come out as often as they came in.
    """
    rules = rules or RULES
    spark = docs.sparkSession
    ledger = ledger or shared_dir(spark)
    known = read_ledger(spark, ledger)
    text = F.coalesce("text", F.lit(""))
    paths = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    wanted = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r[0]).alias("version")) for k, r in rules.items()))
    done = known.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    unseen = blobs.join(done, "blob", "left").select(
        "blob", "doc_id", F.transform(F.array_except(wanted, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>"))), lambda x: x["kind"]).alias("todo")
    ).where(F.size("todo") > 0)
    # the blob's text comes from its representative path; a doc_id that repeats with other texts is told apart by the blob
    holders = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    todo = holders.join(unseen, holders["doc_id"].eqNullSafe(unseen["doc_id"])).select("blob", "todo", "text")
    todo = todo.where(F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("blob")).select("blob", "todo", "text")
    _scan(todo, rules).write.mode("append").parquet(ledger)
    current = F.array(*(F.concat_ws(":", F.lit(k), F.lit(r[0])) for k, r in rules.items()))
    findings = read_ledger(spark, ledger).where((F.size("spans") > 0) & F.array_contains(current, F.concat_ws(":", "kind", "version")))
    findings = findings.dropDuplicates(["blob", "kind"]).groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("kind", "spans"))).alias("kinds"))
    return paths.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("kinds", F.create_map().cast(f"map<string,{SPAN}>")).alias("kinds"))


def _listed(kinds) -> F.Column:
    """kind:start:end of ``kinds`` (in listed order), by start, then kind as listed."""
    def rows(i, kind):
        return F.transform(F.coalesce(F.element_at("kinds", kind), F.array().cast(SPAN)),
                           lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("said")))

    return F.array_join(F.transform(F.array_sort(F.concat(*(rows(i, k) for i, k in enumerate(kinds)))), lambda x: x["said"]), ",")


def digests(found: DataFrame, rules: dict | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    n = {k: F.coalesce(F.size(F.element_at("kinds", k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE_KINDS}
    return found.select("doc_id", *n.values(), F.sha2(_listed(BASE_KINDS), 256).alias("base_sha256"), _listed(rules or RULES).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans once) and n_chars counted anew.

    Rows without findings stay as they were.  Only findings are joined, by doc_id (also
    null) and blob, so each text gets its own.
    """
    names = docs.columns
    flat = found.where(F.size("kinds") > 0).select(F.col("doc_id").alias("__doc"), F.col("blob").alias("__blob"), F.explode(F.flatten(F.map_values("kinds"))).alias("s"))
    spans = flat.groupBy("__doc", "__blob").agg(F.array_sort(F.collect_set(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end")))).alias("__spans"))
    cut = F.aggregate(
        "__spans", F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["kept"], F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .otherwise(acc["kept"]).alias("kept"), F.greatest(acc["at"], s["end"]).alias("at")),
        lambda acc: F.concat(acc["kept"], F.substr("text", (acc["at"] + 1).cast("int"))))
    blob = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(spans["__doc"]) & (blob == spans["__blob"]), "left")
    text = F.when(F.col("__spans").isNotNull() & F.col("text").isNotNull(), cut).otherwise(F.col("text"))
    out = joined.withColumn("__new", text)
    cols = ["__new as text" if c == "text" else "case when __spans is null then n_chars else length(__new) end as n_chars" if c == "n_chars" else f"`{c}`" for c in names]
    return out.selectExpr(*cols)
