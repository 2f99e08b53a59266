"""Documents: clause-aware chunks, relevance ranking, URL manifests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import strings as S
from ..session import cut, small, spread

# Headings at which a clause begins.
HEADINGS = [
    "award criteria", "evaluation criteria", "specification", "scope", "contract terms", "payment", "pricing", "termination", "insurance", "data protection", "tupe", "social value",
    "delivery", "implementation", "key performance", "kpi", "service level", "sla",
]
_HEADING = re.compile(r"^\s*((?:\d+(?:\.\d+)*|[A-Z])[\).]?\s+)?(" + "|".join(HEADINGS) + r")\b", re.I)
CHUNK = "doc_id long, chunk_no int, chunk_id string, heading string, char_start int, char_end int, n_words int, text string"


def tidy(text: str) -> str:
    """One kind of line end, no runs of blanks, at most one empty line."""
    text = re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def clauses(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, heading, text) of the stretches between headings of a tidy text."""
    at, heading, start = 0, "", 0
    lines: list[str] = []
    for line in text.splitlines():
        if _HEADING.match(line):
            if "\n".join(lines).strip():
                yield start, at, heading, "\n".join(lines).strip()
            heading, start, lines = line.strip()[:200], at, []
        elif not lines:
            start = at
        lines.append(line)
        at += len(line) + 1
    if "\n".join(lines).strip():
        yield start, len(text), heading, "\n".join(lines).strip()


def windows(start: int, end: int, block: str, most: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """The block, or overlapping windows of its words if it has too many; a window's place is that of its words with single blanks."""
    ws = block.split()
    if len(ws) <= most:
        yield start, end, block
        return
    step = max(1, most - overlap)
    for i in range(0, len(ws), step):
        part = " ".join(ws[i : i + most])
        s = start + len(" ".join(ws[:i]))
        yield s, min(end, s + len(part)), part
        if i + most >= len(ws):
            return


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 650, overlap: int = 80) -> DataFrame:
    """Chunks of every document: one per clause, long clauses in windows. Null and blank texts have none. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n = 0
                    for s, e, heading, block in clauses(tidy(t or "")):
                        for ws, we, wt in windows(s, e, block, most, overlap):
                            cid = hashlib.sha256(f"{doc}|{ws}|{we}".encode()).hexdigest()[:20]
                            rows.append((doc, n, cid, heading, ws, we, len(wt.split()), wt))
                            n += 1
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                names = [x.split()[0] for x in CHUNK.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    return spread(docs.select(F.col(key).cast("long"), text)).mapInArrow(run, CHUNK)


def term_set(*cols: Column) -> Column:
    """Distinct words in capitals."""
    text = F.concat_ws(" ", *cols)
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"[A-Z0-9]+"), F.lit(0)))


def rank_chunks(found: DataFrame, terms: list[str], k: int = 8, key: str = "chunk_id") -> DataFrame:
    """The k chunks that share most with the terms: overlap over the root of either size, a quarter more if the heading shares a term."""
    want = sorted({t.upper() for t in terms if len(t) >= 3})
    q = F.array(*[F.lit(t) for t in want]).cast("array<string>")
    own = term_set(F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit("")))
    d = found.withColumn("__own", own).withColumn("__both", F.array_intersect("__own", q))
    n = F.size("__both").cast("double")
    bonus = F.when(F.exists("__both", lambda t: F.contains(F.upper(F.col("heading")), t)), 0.25).otherwise(0.0)
    score = F.round(n / F.sqrt(F.size("__own").cast("double")) + n / F.sqrt(F.lit(float(max(1, len(want))))) + bonus, 6)
    return d.where(n > 0).withColumn("score", score).drop("__own", "__both").orderBy(F.desc("score"), F.desc(key)).limit(k)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's words → a row for each different one, and how often it has it."""
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            at, terms, n = [], [], []
            for k, ws in enumerate(part.column(1).to_pylist()):
                c = Counter(ws or ())
                at += [k] * len(c)
                terms += c.keys()
                n += c.values()
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), pa.array(terms, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "term", "tf"])


def tf_idf_top(docs: DataFrame, queries: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`query_id, doc_id, score, rank`: the k documents with the greatest cosine of TF-IDF vectors for each query (`query_id, query`).

    Words are counted where the document stands: only terms with their counts and sums per document are shuffled, as long as the vocabulary
    is small enough for every task (`small`); a larger one is joined by term. Rows of one id are one document; weights come from all documents.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[0-9a-z_]+"), F.lit(0))
    whole = docs.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("ws"))
    if not docs.groupBy(key).count().where("count > 1").isEmpty():
        whole = whole.groupBy("doc_id").agg(F.flatten(F.collect_list("ws")).alias("ws"))
    n = docs.count()
    seen = whole.select(F.explode(F.array_distinct("ws")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = cut(seen.select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    asked = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    q = cut(asked.join(idf, "term").withColumn("qw", F.col("qtf") * F.col("idf")))
    qnorm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    tf = whole.where("doc_id is not null").mapInArrow(_counted, f"doc_id {docs.schema[key].dataType.simpleString()}, term string, tf long")
    dot = tf.join(small(q.select("query_id", "term", "idf", "qw")), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot"))
    w = tf.join(small(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    s = dot.join(norm, "doc_id").join(qnorm, "query_id").select("query_id", "doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def lexical_top(labels: DataFrame, label: str, query: str, k: int = 5) -> DataFrame:
    """Labels nearest to a query: (twice the shared words plus one if one contains the other) over all words; ties: shorter, then smaller."""
    words = sorted(set(re.findall(r"\w+", query.lower())))
    q = F.array(*[F.lit(x) for x in words]).cast("array<string>")
    name, label = label, "label"
    own = F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit(r"\w+"), F.lit(0)))
    inside = F.contains(F.lower(label), F.lit(query.lower())) | F.contains(F.lit(query.lower()), F.lower(label))
    score = (2 * F.size(F.array_intersect(own, q)) + F.when(inside, 1).otherwise(0)) / F.size(F.array_union(own, q))
    return labels.select(F.col(name).alias("label")).distinct().withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), F.length("label"), "label").limit(k)


def url_manifest(docs: DataFrame) -> DataFrame:
    """One row per normalised URL with what is known of the documents that name it."""
    d = docs.withColumn("norm_url", S.normalise_url(F.col("url"))).where("norm_url is not null")
    return d.groupBy("norm_url").agg(
        F.substring(F.sha2("norm_url", 256), 1, 16).alias("url_hash"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ocid").alias("n_ocids"), F.count_distinct("doc_id").alias("n_docs"),
        F.min("date_published").alias("first_published"), F.max("date_published").alias("last_published"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("document_type")), "|").alias("document_types"), F.min("ocid").alias("example_ocid"),
    ).drop("norm_url")


def known_only(docs: DataFrame, known: DataFrame, key: str = "ocid") -> DataFrame:
    """The documents (or chunks) of processes that `known` has; a null key is not known."""
    return docs.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def _list(c: str, most: int | None = None) -> Column:
    """The distinct non-blank values of a group, sorted, as one text; at most the first `most` where that is the feature."""
    x = F.array_sort(F.collect_set(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))))
    return F.array_join(F.slice(x, 1, most) if most else x, "|")


def full_manifest(docs: DataFrame, processes: DataFrame) -> DataFrame:
    """One row per normalised URL with seventeen facts about the documents that name it and their processes (`ocid, year, buyer_name`, one row
    an ocid). Documents of unknown processes have no year or buyer. Samples (ten processes and buyers, three texts' beginnings) are samples."""
    d = docs.withColumn("norm_url", S.normalise_url(F.col("url"))).where("norm_url is not null").join(processes, "ocid", "left")
    return d.groupBy("norm_url").agg(
        F.substring(F.sha2("norm_url", 256), 1, 16).alias("url_hash"), _list("source").alias("source_group"), _list("document_type").alias("document_types"), _list("field_path").alias("field_paths"),
        _list("lang").alias("langs"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), _list("year").alias("years"), F.count_distinct("ocid").alias("n_ocids"), F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("doc_id").alias("n_docs"), F.min(F.when(F.trim("buyer_name") != "", F.col("buyer_name"))).alias("first_buyer"), _list("buyer_name", 10).alias("buyers"), _list("ocid", 10).alias("sample_ocids"),
        _list("lot_id", 10).alias("lots"), F.min("date_published").alias("first_published"), F.max("date_published").alias("last_published"),
    ).drop("norm_url")
