"""Near duplicates and shared passages against brute force, on texts made to mislead candidate searches."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandline.llm import near_dedup, substrings
from tests.llm.test_llm import no_docs, odd_docs, words

SCHEMA = "doc_id long, text string"


def fresh(rng, n, kind="u"):
    return [f"{kind}{rng.randrange(10**9)}" for _ in range(n)]


def uncovered(docs, rows, least=50):
    """Runs of equal words in two documents that no passage holds, of either side."""
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r["first"], r["last"]))
        spans[r.match_id].append((r.match_first, r.match_last))
    runs = defaultdict(list)
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - least + 1):
            runs[tuple(w[i : i + least])].append((doc, i))
    missed = 0
    for places in runs.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                missed += not all(any(a <= p <= b for a, b in spans[d]) for p in range(i, i + least))
    return missed


def test_a_passage_whose_short_runs_stand_elsewhere(spark):
    rng = random.Random(11)
    passage = fresh(rng, 60, "p")
    docs = []
    for i in range(53 * 6):
        at = i % 53
        docs.append((i, " ".join(fresh(rng, 30) + passage[at : at + 8] + fresh(rng, 30))))
    docs += [(5000 + i, " ".join(fresh(rng, 40) + passage + fresh(rng, 40))) for i in range(2)]
    rows = substrings.passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {(r.doc_id, r.match_id) for r in rows} == {(5001, 5000)}
    assert uncovered(docs, rows) == 0


@pytest.mark.parametrize("size", [50, 51, 60])
def test_passages_that_older_documents_hold_in_part(spark, size):
    rng = random.Random(size)
    docs = []
    for n in range(40):
        passage, base = fresh(rng, size, "p"), 10 * n
        docs += [(base, " ".join(fresh(rng, 20) + passage[: size - 15] + fresh(rng, 20))), (base + 1, " ".join(fresh(rng, 20) + passage[15:] + fresh(rng, 20)))]
        docs += [(base + 2 + i, " ".join(fresh(rng, 30) + passage + fresh(rng, 30))) for i in range(2)]
    rows = substrings.passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert uncovered(docs, rows) == 0
    assert {r.doc_id for r in rows} >= {10 * n + 3 for n in range(40)}


def test_all_equal_runs_of_the_sample_are_found(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if r.text]
    assert uncovered(docs, substrings.passages(spark.createDataFrame(docs, SCHEMA)).collect()) == 0


def test_fuzzy_passages_by_identity(spark):
    """Of passages of 80 words with every nth word changed, or with words put in and left out."""
    rng = random.Random(12)
    docs, found, steps = [], {}, (6, 8, 10, 13, 20, 27)
    for step in (*steps, 0):
        for n in range(60):
            passage, base = fresh(rng, 80, "p"), 10000 * step + 10 * n
            if step:
                other = [f"c{rng.randrange(10**9)}" if i % step == step - 1 else w for i, w in enumerate(passage)]
            else:
                other = list(passage)
                for p in rng.sample(range(78), 4):
                    other[p : p + 1] = rng.choice(([], [*fresh(rng, 1), other[p]]))
            docs += [(base, " ".join(fresh(rng, 40) + passage + fresh(rng, 40))), (base + 1, " ".join(fresh(rng, 40) + other + fresh(rng, 40)))]
    rows = substrings.passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert all(r.match_id == r.doc_id - 1 and r["identity"] >= 0.8 for r in rows)
    for step in (*steps, 0):
        found[step] = len({r.doc_id for r in rows if r.doc_id // 10000 == step}) / 60
    assert min(found.values()) >= 0.9 and found[27] == found[20] == found[13] == 1, found


def test_passages_of_rows_that_share_an_id(spark):
    rng = random.Random(14)
    p, q = " ".join(fresh(rng, 60, "p")), " ".join(fresh(rng, 60, "q"))
    for up in (0, 2**62):
        docs = [(up + 1, p), (up + 1, "other " * 60), (up + 2, p), (up + 2, q), (up + 3, q), (up + 3, q)]
        rows = substrings.passages(spark.createDataFrame(docs, SCHEMA)).collect()
        assert sorted((r.doc_id - up, r.match_id - up, r["first"], r["last"]) for r in rows) == [(2, 1, 0, 59), (3, 2, 0, 59)]


def test_passages_far_beyond_their_seeds(spark):
    """Nearly all seeds of a long passage link to older documents that hold 30 words of it."""
    rng = random.Random(15)
    long = fresh(rng, 3000, "p")
    docs = [(n, " ".join(fresh(rng, 5) + long[25 * n : 25 * n + 30] + fresh(rng, 5))) for n in range(119) if not 50 <= n < 53]
    docs += [(1000 + i, " ".join(fresh(rng, 20) + long + fresh(rng, 20))) for i in range(2)]
    rows = substrings.passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert uncovered(docs, rows) == 0 and max(r["last"] - r["first"] for r in rows if r.doc_id == 1001) >= 2990


def test_best_chain_is_that_of_all_pairs(spark):
    rng = random.Random(16)
    for _ in range(200):
        links = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 25))})
        score = [8.0] * len(links)
        for m, (x, y) in enumerate(links):
            for n, (u, v) in enumerate(links[:m]):
                if u < x and v < y:
                    score[m] = max(score[m], 8 + score[n] - substrings.GAP * (x - u + y - v))
        a, b = (np.array(c) for c in zip(*links, strict=True))
        best = [links[i] for i in substrings.chains(a, b, 8)[0]]
        got = 8 * len(best) - sum(substrings.GAP * (x - u + y - v) for (u, v), (x, y) in zip(best[:-1], best[1:], strict=True))
        assert got == pytest.approx(max(score))


def test_passages_of_odd_rows(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    odd = substrings.passages(odd_docs(spark)).collect()
    assert {r.doc_id for r in odd} <= {3}
    named = spark.createDataFrame([("b", shared, 1), (None, shared + " x", 2), ("a", "y " + shared, 3), ("c", None, 4)], "doc_id string, text string, head int")
    got = substrings.passages(named).collect()
    assert len(got) == 2 and {r.doc_id for r in got} | {r.match_id for r in got} == {"a", "b", None}
    assert substrings.passages(no_docs(spark)).count() == 0


def similar(docs, threshold=0.8):
    """Pairs whose runs of five words reach the threshold as sets with counts, and stand in order."""
    tokens = {}
    for doc, text in docs:
        w, seen, out = words(text), Counter(), []
        for i in range(max(1, len(w) - 4)) if w else ():
            t = tuple(w[i : i + 5])
            out.append((t, seen[t]))
            seen[t] += 1
        tokens[doc] = out
    holders = defaultdict(set)
    for d, ts in tokens.items():
        for t in ts:
            holders[t].add(d)
    for d, ts in tokens.items():
        common = Counter(e for t in ts for e in holders[t] if e > d)
        for e, n in common.items():
            if n / (len(ts) + len(tokens[e]) - n) >= threshold:
                at = {t: i for i, t in enumerate(tokens[e])}
                run = [at[t] for t in ts if t in at]
                if run == sorted(run):
                    yield d, e


def missed(docs, rows):
    label = {r.doc_id: r.class_id for r in rows}
    pairs = list(similar(docs))
    return sum(label[a] != label[b] for a, b in pairs), len(pairs)


def test_near_copies_behind_a_common_passage(spark):
    rng = random.Random(13)
    common, docs = fresh(rng, 300, "c"), []
    for n in range(700):
        own = fresh(rng, 130)
        docs.append((10 * n, " ".join(common + own)))
        if n % 3 == 0:
            other = list(own)
            for p in rng.sample(range(130), rng.randrange(1, 9)):
                other[p] = f"e{rng.randrange(10**9)}"
            docs.append((10 * n + 1, " ".join(common + other)))
    rows = near_dedup.near_classes(spark.createDataFrame(docs, SCHEMA)).collect()
    lost, of = missed(docs, rows)
    assert of > 100 and lost == 0
    assert max(Counter(r.class_id for r in rows).values()) == 2


def test_near_copies_of_the_sample(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    lost, of = missed(docs, near_dedup.near_classes(spark.createDataFrame(docs, SCHEMA)).collect())
    assert of > 50 and lost == 0
