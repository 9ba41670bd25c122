"""Language ID by Bayesian fusion of evidence.

For each language l of a closed list the posterior of a row is

    P(text | l) * P(declared | l) * P(suffix | l) * P(l | host)

* Text: a multinomial model over hashed letter trigrams, counted over all rows
  under their declared language. Neighbouring trigrams overlap and repeat, so
  each counts a tenth.
* Declared markup language and address suffix: how often each value goes with
  each language, from grouped sums of text posteriors over all rows.
* Host: a prior smoothed from the host to its domain to all rows, each level
  a grouped sum of text posteriors; the row's own share is taken out.

A further hypothesis, text in none of the languages, spreads evenly over all
trigrams. Rows that it wins, or whose best posterior is below a half, are
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectgrid.llm.tables import only, stored
from effectgrid.llm.words import LOWER, pieces

#: Languages that are always known; others are if this many rows declare them.
LANGUAGES = ("de", "en", "es", "fr")
LEAST_DECLARED = 50
BUCKETS = 1 << 12
TEMPER = 0.1
#: Rows that a level's prior weighs against a host's or domain's own.
STRENGTH = 20.0
LEAST_POSTERIOR = 0.5

#: ASCII letters and all bytes of longer characters stay, the rest is one blank.
_LETTER = LOWER.copy()
_LETTER[[i for i in range(128) if not (97 <= LOWER[i] <= 122)]] = 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams inside the texts, and where each text's begin (and the end)."""
    low = _LETTER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    keep = code != 0x202020
    for k in (1, 2):  # not across the begin of a text
        at = offsets[1:-1] - k
        keep[at[(at >= 0) & (at < len(keep))]] = False
    where = np.flatnonzero(keep)
    bucket = (code[where] * np.uint32(2654435761)) >> np.uint32(20)
    return bucket.astype(np.int64), np.searchsorted(where, offsets)


def _count(languages: tuple[str, ...]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages) + 1) * BUCKETS, np.int64)
        for batch in batches:
            declared = np.array([number.get(x, len(languages)) for x in batch.column(1).to_pylist()], np.int64)
            for i, j, data, offsets in pieces(batch.column(0)):
                bucket, first = trigrams(data, offsets)
                row = np.repeat(declared[i:j], np.diff(first))
                total += np.bincount(row * BUCKETS + bucket, minlength=len(total))
        at = np.flatnonzero(total[: len(languages) * BUCKETS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // BUCKETS, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(total[at], pa.int64())],
            ["language", "bucket", "n"],
        )

    return run


def text_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """ln P(bucket | language): a table of fixed size, from counts over all rows."""
    counts = rows.select("text", "declared").mapInArrow(_count(languages), "language int, bucket int, n long")
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in counts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect():  # at most languages x BUCKETS rows
        table[r.language, r.bucket] += r.n
    return np.log(table / table.sum(axis=1, keepdims=True))


def _score(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rest = [c for c in names if c != "text"]
            for i, j, data, offsets in pieces(batch.column(names.index("text"))):
                bucket, first = trigrams(data, offsets)
                sums = []
                for logs in model:
                    c = np.zeros(len(bucket) + 1)
                    np.cumsum(logs[bucket], out=c[1:])
                    sums.append(c[first[1:]] - c[first[:-1]])
                n = np.diff(first)
                logs = TEMPER * np.stack([*sums, n * -np.log(BUCKETS)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(names.index(c))[i:j] for c in rest), pa.array(n, pa.int64()), pa.array(list(logs), pa.list_(pa.float64()))],
                    [*rest, "n_trigrams", "logs"],
                )

    return run


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _sums(count: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(count)]


def known_languages(rows: DataFrame, always: tuple[str, ...] = LANGUAGES, least: int = LEAST_DECLARED) -> tuple[str, ...]:
    """The languages that are always known and all two-letter codes that `least` rows declare, by one grouped count."""
    declared = rows.select(F.lower(F.substring("declared", 1, 2)).alias("code")).where(F.col("code").rlike("^[a-z]{2}$"))
    # at most 676 rows
    found = declared.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()
    return tuple(sorted({*always, *(r["code"] for r in found)}))


def identify(rows: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Of frames (key, text, declared, suffix, host, domain) one row per row.

    Adds language (null if rejected), posterior, text_language and accepted;
    text is left out. Null evidence of any kind says nothing; texts without
    trigrams are judged by the rest. An empty table gives an empty result. Without
    stated languages the known ones come from the declared codes of all rows.
    """
    languages = known_languages(rows) if languages is None else languages
    count = len(languages)
    rows = rows.withColumn("declared", F.lower(F.substring("declared", 1, 2)))
    model = text_model(rows, languages)
    scored = rows.mapInArrow(
        _score(model), _schema(rows, ["text"]) + ", n_trigrams long, logs array<double>"
    )
    scored = stored(scored.withColumn("p", _softmax(F.slice("logs", 1, count))))
    tagged = F.col("n_trigrams") > 0

    # P(value | language) for the declared language and the suffix: one short row per value
    def evidence(column: str) -> DataFrame:
        known = scored.where(tagged & F.col(column).isNotNull())
        table = known.groupBy(column).agg(*_sums(count))
        values, *totals = table.agg(F.count(F.lit(1)), *(F.sum(f"s{i}") for i in range(count))).first()  # one row of numbers
        logs = [F.log((F.col(f"s{i}") + 1.0) / F.lit((totals[i] or 0.0) + values + 1.0)) for i in range(count)]
        return table.select(column, F.array(*logs).alias(f"{column}_logs"))

    # host to domain to all rows; text posteriors are summed, combined in the map tasks
    def level(column: str) -> DataFrame:
        return scored.where(tagged & F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(f"{column}_n"), F.array(*_sums(count)).alias(f"{column}_p"))

    n, *sums = scored.where(tagged).agg(F.count(F.lit(1)), *_sums(count)).first()  # one row of numbers
    out = scored.withColumns({"all_n": F.lit(n), "all_p": F.array(*(F.lit(x or 0.0) for x in sums))})
    for table, column in ((evidence("declared"), "declared"), (evidence("suffix"), "suffix"), (level("host"), "host"), (level("domain"), "domain")):
        out = out.join(table, column, "left")

    def smoothed(column: str, above: Column) -> Column:
        own = F.when(tagged, F.lit(1.0)).otherwise(0.0)
        n = F.greatest(F.lit(0.0), F.coalesce(F.col(f"{column}_n"), F.lit(0)) - own)
        sums = F.coalesce(F.col(f"{column}_p"), F.array_repeat(F.lit(0.0), count))
        less = F.zip_with(sums, "p", lambda s, p: F.greatest(F.lit(0.0), F.coalesce(s, F.lit(0.0)) - p * own))
        return F.zip_with(less, above, lambda s, a: (s + STRENGTH * a) / (n + STRENGTH))

    flat = F.array_repeat(F.lit(1.0 / count), count)
    out = out.withColumn("all_prior", smoothed("all", flat))
    out = out.withColumn("domain_prior", F.when(F.col("domain").isNull(), F.col("all_prior")).otherwise(smoothed("domain", F.col("all_prior"))))
    out = out.withColumn("prior", F.when(F.col("host").isNull(), F.col("domain_prior")).otherwise(smoothed("host", F.col("domain_prior"))))
    nothing = F.array_repeat(F.lit(0.0), count)
    parts = [F.slice("logs", 1, count), F.coalesce("declared_logs", nothing), F.coalesce("suffix_logs", nothing), F.transform("prior", lambda x: F.log(x))]
    fused = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
    # the hypothesis of no known language: the same other evidence as the average language
    other = F.aggregate(F.zip_with(fused, F.slice("logs", 1, count), lambda a, b: a - b), F.lit(0.0), lambda a, x: a + x) / count
    out = out.withColumn("fused", F.concat(fused, F.array(F.element_at("logs", -1) + other - F.log(F.lit(10.0)))))
    out = out.withColumn("post", _softmax(F.col("fused")))
    best = F.array_max("post")
    at = F.array_position("post", best)
    named = F.element_at(F.array(*map(F.lit, languages), F.lit(None).cast("string")), at.cast("int"))
    text_best = F.element_at(F.array(*map(F.lit, languages)), F.array_position("p", F.array_max("p")).cast("int"))
    out = out.withColumns(
        {
            "posterior": F.round(best, 6),
            "accepted": named.isNotNull() & (best >= LEAST_POSTERIOR),
            "text_language": F.when(tagged, text_best),
        }
    ).withColumn("language", F.when(F.col("accepted"), named))
    kept = [c for c in rows.columns if c != "text"]
    return out.select(*kept, "language", "posterior", "text_language", "accepted")


def _schema(df: DataFrame, without: list[str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in without)


def page_rows(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Visible text, declared language, and host, domain and suffix of the address of web pages."""
    html = F.coalesce(F.col(f"`{html_column}`"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*)", 1)
    declared = F.regexp_extract(tag, r"""(?i)\blang\s*=\s*["']?([a-z]{2})""", 1)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_column}`"), F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(
        F.col(f"`{id_column}`").cast("long").alias("key"),
        text.alias("text"),
        blank(declared).alias("declared"),
        blank(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
        blank(host).alias("host"),
        blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
    )


def document_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", declared_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Documents: their language column is the declared language, their source the host."""
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("key"),
        F.col(f"`{text_column}`").alias("text"),
        F.col(f"`{declared_column}`").cast("string").alias("declared"),
        F.lit(None).cast("string").alias("suffix"),
        F.col(f"`{source_column}`").cast("string").alias("host"),
        F.lit(None).cast("string").alias("domain"),
    )


def in_known_language(docs: DataFrame, id_column: str = "doc_id", **names) -> DataFrame:
    """The documents that are not rejected, with all their columns.

    Of rows with one id all go if one is rejected; rows with a null id stay.
    """
    used = [id_column, *(names.get(k, v) for k, v in (("text_column", "text"), ("declared_column", "lang"), ("source_column", "source")))]
    found = identify(document_rows(only(docs, *dict.fromkeys(used)), id_column, **names))
    # written before it is filtered, so that the fusion is computed once for each row
    found = stored(found.select("key", "accepted"))
    out = found.where(~F.col("accepted")).select(F.col("key").alias("__gone"))
    return docs.join(out, F.col(f"`{id_column}`").cast("long") == F.col("__gone"), "left_anti")
