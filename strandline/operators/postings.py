"""A stored text index: postings with positions and weights, from which BM25 and text ranks are answered without reading texts again.

``postings``: ``term, key, tf, length, positions, weights``, in folders by a hash of the term, sorted by term and key; a common term lies in several files of its folder, and a
scan for few terms reads their folders only. ``terms``: ``term, df, bound``, the bound being the largest BM25 share that one document has of the term.
``about``: the number of documents and their mean length. All are Parquet in a folder of the cluster's store.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.functions import rules, stems
from strandline.functions.scalars import tokens

from .lineage import cut
from .search import scored

#: Weights of a field's letter (fixed values).
LETTERS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
K1, B = 1.5, 0.75
#: Parts that a common term's postings are dealt over in a join.
SALT = 16
#: Words whose postings a folder holds, about, and most folders.
FOLDER_WORDS, MOST_FOLDERS = 10_000_000, 4096
#: Words further apart than this add nothing to a rank by closeness.
FAR = 100


def build(docs: DataFrame, path: str, key: str = "doc_id", fields: dict[str, str] | None = None, analyzer: str = "simple") -> None:
    """Indexes all words of the fields (column: letter of weight), one field's positions after the other's.

    ``simple`` keeps words as they are, ``english`` drops stop words and strips suffixes. Null texts are empty; null keys are left out, and keys that repeat are
    refused. A document's words are gathered where it is read: only its distinct terms, with their places, are sent to the terms' files.
    """
    if analyzer not in ("simple", "english"):
        raise ValueError(f"analyzer {analyzer!r} is neither simple nor english")
    spark, english = docs.sparkSession, analyzer == "english"
    fields = fields or {"text": "D"}
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(tokens(F.col(c)).alias(f"w{i}") for i, c in enumerate(fields)))
    if rows.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats")
    letters, kind = [LETTERS[x] for x in fields.values()], rows.schema["key"].dataType

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts, out = [part.column(f"w{i}").to_pylist() for i in range(len(letters))], ([], [], [], [], [], [])
                for key_of, *lists in zip(part.column("key").to_pylist(), *texts, strict=True):
                    places: dict[str, list[int]] = {}
                    ends = np.cumsum([len(ws) for ws in lists])
                    for at, w in enumerate(chain.from_iterable(lists), 1):
                        places.setdefault(w, []).append(at)
                    if english:
                        stemmed: dict[str, list[int]] = {}
                        for w, ps in places.items():
                            if w not in stems.STOP_WORDS:
                                stemmed.setdefault(stems.stem(w), []).extend(ps)
                        places = {w: sorted(ps) for w, ps in stemmed.items()}
                    out[0].extend(places)
                    out[1].extend([key_of] * len(places))
                    out[2].extend(map(len, places.values()))
                    out[3].extend([int(ends[-1])] * len(places))
                    out[4].extend(places.values())
                    of = letters[0] if len(letters) == 1 else None
                    out[5].extend([of] * len(ps) if of else [letters[i] for i in np.searchsorted(ends, ps)] for ps in places.values())
                kinds = [pa.string(), to_arrow_type(kind), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["term", "key", "tf", "length", "positions", "weights"])

    post = rows.mapInArrow(gather, f"term string, key {kind.simpleString()}, tf int, length int, positions array<int>, weights array<double>")
    about = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(sum(F.size(f"w{i}") for i in range(len(fields)))), F.lit(0.0)).alias("avg_length"))
    n, mean = about.head()
    folders = min(MOST_FOLDERS, 1 + int(n * mean) // FOLDER_WORDS)
    about = spark.createDataFrame([(n, mean, folders, kind.simpleString())], "n long, avg_length double, folders int, kind string").coalesce(1)
    about.write.parquet(f"{path}/about")
    files = F.pmod(F.xxhash64("key"), F.lit(min(SALT, folders)))
    post.withColumn("folder", _folder(folders)).repartition(folders * min(SALT, folders), "folder", files).sortWithinPartitions("folder", "term", "key").write.partitionBy("folder").parquet(f"{path}/postings")
    about = spark.read.parquet(f"{path}/about").drop("folders", "kind")  # one row
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    stored(spark, path).select("term", "tf", "length").crossJoin(F.broadcast(about)).groupBy("term").agg(F.count("*").alias("df"), F.max(part).alias("bound")).write.parquet(f"{path}/terms")


def _folder(folders: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All postings, with the ``folder`` they lie in."""
    kind = spark.read.parquet(f"{path}/about").head()["kind"]
    return spark.read.schema(f"term string, key {kind}, tf int, length int, positions array<int>, weights array<double>, folder int").parquet(f"{path}/postings")


def of_terms(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """Postings of the given terms (``term``), from their folders only: the folders to read are found first, a number that is bounded."""
    folders = spark.read.parquet(f"{path}/about").head()["folders"]
    read = [r["folder"] for r in terms.select(_folder(folders).alias("folder")).distinct().collect()]
    return stored(spark, path).filter(F.col("folder").isin(read)).drop("folder").join(terms.select("term").distinct(), "term", "left_semi")


def _asked(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """``query, term, times, df, idf, bound`` of the queries' terms that occur."""
    about = spark.read.parquet(f"{path}/about").drop("folders", "kind")  # one row
    asked = queries.groupBy("query", "term").agg(F.count("*").alias("times")).join(spark.read.parquet(f"{path}/terms"), "term").crossJoin(F.broadcast(about))
    asked = asked.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("times"))
    return cut(asked.withColumn("bound", F.col("idf") * F.col("bound")))


def bm25_top(spark: SparkSession, path: str, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """``query, key, score, rank``: each query's k best documents by BM25, exactly, ties by key; ``queries`` has ``query, term``, a term given twice counts twice.

    The asked terms' postings are gathered by document, once for all queries, and each task keeps the k best of its documents for each query: what is shuffled grows
    with the postings, not with the pairs of queries and documents. Scores are rounded to ``digits`` before they are compared.
    """
    asked = _asked(spark, path, queries)
    post = of_terms(spark, path, asked).select("key", "length", "term", "tf")
    rows = post.groupBy("key", "length").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tf"))
    return scored(rows, asked.select("query", "term", "idf"), spark.read.parquet(f"{path}/about").head()["avg_length"] or 1.0, K1, B, k, digits)


# --- ranks by position -----------------------------------------------------------------------------------------


def parsed(text: str | None, english: bool) -> list[dict]:
    """Alternatives of a query as ``alt, unit, off, term, no``: the words of each unit (a word or phrase), whether it must not occur."""
    out = []
    for alt, (wanted, unwanted) in enumerate(rules.websearch(text or "")):
        for unit, (phrase, no) in enumerate([(w, False) for w in wanted] + [(w, True) for w in unwanted]):
            for off, word in enumerate(phrase.split(" ")):
                if not english or word not in stems.STOP_WORDS:
                    out.append({"alt": alt, "unit": unit, "off": off, "term": stems.stem(word) if english else word, "no": no})
    return out


def _parsed(english: bool):
    """:func:`parsed` as a function of a column."""

    @F.pandas_udf("array<struct<alt: int, unit: int, off: int, term: string, no: boolean>>")
    def parse(said: pd.Series) -> pd.Series:
        return said.map(lambda text: parsed(text, english))

    return parse


def covers(units: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Minimal intervals that hold an occurrence (start, end) of every unit, none within another."""
    ends = np.unique(np.concatenate([e for _, e in units]))
    begin = np.full(len(ends), np.iinfo(np.int64).max)
    for s, e in units:
        at = np.searchsorted(e, ends, "right") - 1
        begin = np.minimum(begin, np.where(at >= 0, s[at.clip(0)], -1))
    ends, begin = ends[begin >= 0], begin[begin >= 0]
    first = np.unique(begin, return_index=True)[1]  # begins never fall: the first end of each is minimal
    return [(int(begin[i]), int(ends[i])) for i in first]


def _occurrences(words: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a unit: places where its words stand in a row."""
    start = None
    for w in words:
        at = np.asarray(w["positions"], np.int64) - w["off"]
        start = at if start is None else np.intersect1d(start, at)
    lo, hi = min(w["off"] for w in words), max(w["off"] for w in words)
    return start + lo, start + hi


def both_ranks(rows: list[dict], asked: list[dict]) -> tuple[float, float] | None:
    """(cover density, frequency or closeness) of one document for one query; none where no alternative holds."""
    have: dict = {}
    for r in rows:
        have.setdefault((r["alt"], r["unit"]), []).append(r)
    found, used = [], {}
    for alt in sorted({a["alt"] for a in asked}):
        units, words, ok = [], {}, True
        for unit in sorted({a["unit"] for a in asked if a["alt"] == alt}):
            need = [a for a in asked if a["alt"] == alt and a["unit"] == unit]
            there = have.get((alt, unit), [])
            at = _occurrences(there) if len(there) == len(need) else (np.zeros(0, np.int64),) * 2
            if need[0]["no"]:
                ok &= not len(at[0])
            else:
                ok &= len(at[0]) > 0
                units.append(at)
                words |= {w["term"]: w for w in there}
        if ok and units:
            found += covers(units)
            used |= words
    if not found:
        return None
    found = [c for c in set(found) if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in found)] if len({a["alt"] for a in asked}) > 1 else found
    place = np.concatenate([np.asarray(w["positions"], np.int64) for w in used.values()])
    weight = np.concatenate([np.asarray(w["weights"], float) for w in used.values()])
    order = np.argsort(place, kind="stable")
    place, inverse = place[order], np.concatenate([[0.0], np.cumsum(1 / weight[order])])
    dense = 0.0
    for lo, hi in found:
        a, b = np.searchsorted(place, lo), np.searchsorted(place, hi, "right")
        dense += (b - a) / (inverse[b] - inverse[a]) / (1 + max(0, (hi - lo) - (b - a - 1)))
    return dense, closeness(list(used.values())) if len({a["alt"] for a in asked}) == 1 and len(used) > 1 else frequency(list(used.values()), len({a["term"] for a in asked if not a["no"]}))


def frequency(words: list[dict], asked: int) -> float:
    """The rank of alternatives: of each term the heaviest place counts whole and each other by the square of its number, over what an endless row would give."""
    total = 0.0
    for w in words:
        x = np.asarray(w["weights"], float)
        own = (x / np.arange(1, len(x) + 1) ** 2).sum()
        top = int(x.argmax())
        total += (x[top] + own - x[top] / (top + 1) ** 2) / 1.64493406685
    return total / max(1, asked)


def closeness(words: list[dict]) -> float:
    """The rank of terms that must all occur: every two places of two terms, up to ``FAR`` apart, by their weights and distance."""
    left = 0.0
    for i, a in enumerate(words):
        pa, xa = np.asarray(a["positions"], np.int64), np.asarray(a["weights"], float)
        for b in words[:i]:
            pb, xb = np.asarray(b["positions"], np.int64), np.asarray(b["weights"], float)
            lo, hi = np.searchsorted(pb, pa - FAR), np.searchsorted(pb, pa + FAR, "right")
            one = np.repeat(np.arange(len(pa)), hi - lo)
            other = np.arange(len(one)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            apart = np.abs(pa[one] - pb[other])
            one, other, apart = one[apart > 0], other[apart > 0], apart[apart > 0]
            near = 1 / (1.005 + 0.05 * np.exp(apart / 1.5 - 2))
            left += np.log1p(-np.minimum(np.sqrt(xa[one] * xb[other] * near), 1 - 1e-15)).sum()
    return float(1 - np.exp(left))


def text_ranks(spark: SparkSession, path: str, queries: DataFrame, analyzer: str = "simple") -> DataFrame:
    """``query, key, dense, rank_plain`` of documents that match a web-style query (``query, said``: words, "phrases", OR, -word).

    ``dense`` is the cover density: over minimal covers of the query, the harmonic mean of the weights of its words in them, over one more than the number of other words between. ``rank_plain`` counts
    frequencies, or, where all of several terms must occur, closeness of pairs. Every alternative starts from the documents of its rarest term, and its other terms are
    looked up for those only. Alternatives without a wanted word, or with a wanted word that nowhere occurs, match nothing.
    """
    alike = cut(queries.filter("query IS NOT NULL AND said IS NOT NULL").select("query", "said").distinct())
    each = alike.select("said").distinct().select(F.col("said").alias("query"), _parsed(analyzer == "english")("said").alias("asked")).filter("size(asked) > 0")
    each = cut(each)
    terms = each.select("query", F.explode("asked").alias("a")).select("query", "a.*")
    sizes = terms.join(spark.read.parquet(f"{path}/terms").select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = Window.partitionBy("query", "alt").orderBy("df", "term", "unit", "off")
    rarest = sizes.filter("NOT no").withColumn("n", F.row_number().over(first)).filter("n = 1 AND df > 0").select("query", "term").distinct()
    rarest = cut(rarest)
    keys = cut(rarest.join(of_terms(spark, path, rarest).select("term", "key"), "term").select("query", "key").distinct())
    wanted = of_terms(spark, path, terms).select("term", "key", "positions", "weights")
    hits = keys.join(terms, "query").join(wanted, ["term", "key"])
    gathered = hits.groupBy("query", "key").agg(F.collect_list(F.struct("alt", "unit", "off", "term", "positions", "weights")).alias("rows")).join(each, "query")

    @F.pandas_udf("struct<dense: double, plain: double>")
    def ranks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for rows, asked in batches:
            got = [both_ranks(list(r), list(a)) or (None, None) for r, a in zip(rows, asked, strict=True)]
            yield pd.DataFrame(got, columns=["dense", "plain"], dtype=float)

    found = gathered.select("query", "key", ranks("rows", "asked").alias("r")).filter("r.dense IS NOT NULL").select(F.col("query").alias("said"), "key", "r.dense", F.col("r.plain").alias("rank_plain"))
    return found.join(F.broadcast(alike), "said").select("query", "key", "dense", "rank_plain")  # equal queries are answered once
