"""The text index against plain loops: BM25, minimal covers, ranks, phrases, stems."""

import math
import random
import re

import numpy as np
import pytest

from strandline.functions.stems import STOP_WORDS, stem
from strandline.operators import postings

DOCS = "doc_id long, text string, title string"


def texts(seed, n=150):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("aaaabbbccdefgh") for _ in range(rng.randrange(40))), rng.choice("abz")) for i in range(n)] + [(900, None, None), (901, "", "z"), (None, "a b", "a")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "p")
    postings.build(spark.createDataFrame(texts(1), DOCS).repartition(3), path)
    return path


def plain_bm25(docs, terms):
    words = {k: (t or "").split() for k, t, _ in docs if k is not None}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for t in terms:
        df = sum(t in w for w in words.values())
        for k, w in words.items():
            if t in w:
                tf = w.count(t)
                out[k] = out.get(k, 0) + math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    return out


@pytest.mark.parametrize("k", [1, 5, 60, 1000])
def test_top_by_bm25_loses_nothing(spark, index, k):
    asked = {1: "ab", 2: "ah", 3: "hgfe", 4: "aah", 5: "z", 6: "abcdefgh", 7: "a"}
    got = postings.bm25_top(spark, index, spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query long, term string"), k, digits=9).collect()
    for q, ts in asked.items():
        want = sorted(((round(-s, 9), key) for key, s in plain_bm25(texts(1), ts).items()))[:k]
        assert [(r.key, pytest.approx(-s, abs=2e-9)) for r, (s, _) in zip(sorted((r for r in got if r.query == q), key=lambda r: r["rank"]), want, strict=True)] == [(key, -s) for s, key in want]


def test_common_terms_are_looked_up_only_where_they_can_win(spark, tmp_path):
    docs = [(i, "the " * 3 + ("rare " * 5 if i < 20 else "other words here"), "") for i in range(400)]
    postings.build(spark.createDataFrame(docs, DOCS), str(tmp_path / "p"))
    got = postings.bm25_top(spark, str(tmp_path / "p"), spark.createDataFrame([(1, "the"), (1, "rare")], "query long, term string"), 5)
    assert [r.key for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    # the list of the common term is joined by key: no stage multiplies it
    assert "late" not in got.columns


def plain_covers(words, units):
    spans = [[(i, i + len(u) - 1) for i in range(len(words) - len(u) + 1) if words[i : i + len(u)] == u] for u in units]
    holds = lambda b, e: all(any(b <= s and t <= e for s, t in own) for own in spans)
    every = [(b, e) for b in range(len(words)) for e in range(b, len(words)) if holds(b, e)]
    return sorted(c for c in every if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in every))


def plain_matches(words, said):
    """(cover density, whether it matches) with all weights 0.1, by definition."""
    found, used = set(), set()
    for alt in said:
        wanted, unwanted = alt
        has = lambda u: any(words[i : i + len(u)] == u for i in range(len(words) - len(u) + 1))
        if wanted and all(has(u) for u in wanted) and not any(has(u) for u in unwanted):
            found |= set(plain_covers(words, wanted))
            used |= {w for u in wanted for w in u}
    found = [c for c in found if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in found)]
    total = 0.0
    for b, e in found:
        k = sum(w in used for w in words[b : e + 1])
        total += 0.1 / (1 + (e - b) - (k - 1))
    return total if found else None


SAID = {1: ("a h", [([["a"], ["h"]], [])]), 2: ('"a b" c', [([["a", "b"], ["c"]], [])]), 3: ('g OR "b b"', [([["g"]], []), ([["b", "b"]], [])]), 4: ("a -b", [([["a"]], [["b"]])]), 5: ('e -"a a" OR f h', [([["e"]], [["a", "a"]]), ([["f"], ["h"]], [])]), 6: ("zzz a", [([["zzz"], ["a"]], [])]), 7: ("-a", [([], [["a"]])]), 8: ("", [])}


def test_cover_density_against_every_interval(spark, index):
    queries = spark.createDataFrame([(q, s) for q, (s, _) in SAID.items()] + [(9, None)], "query long, said string")
    got = {(r.query, r.key): r.dense for r in postings.text_ranks(spark, index, queries).collect()}
    want = {(q, k): d for q, (_, said) in SAID.items() for k, t, _ in texts(1) if k is not None for d in [plain_matches((t or "").split(), said)] if d is not None}
    assert set(got) == set(want) and len({q for q, _ in got}) == 5
    assert all(got[x] == pytest.approx(want[x]) for x in want)


def test_weights_and_frequency(spark, tmp_path):
    postings.build(spark.createDataFrame([(1, "b a a", "a"), (2, "b b", "c")], DOCS), str(tmp_path / "p"), fields={"title": "A", "text": "B"})
    got = {(r.query, r.key): r for r in postings.text_ranks(spark, str(tmp_path / "p"), spark.createDataFrame([(1, "a"), (2, "a OR c"), (3, "a b")], "query long, said string")).collect()}
    one = 1.0 + 0.4 / 4 + 0.4 / 9
    assert got[1, 1].rank_plain == pytest.approx((1.0 + one - 1.0) / 1.64493406685)
    assert got[2, 2].rank_plain == pytest.approx(1.0 / 1.64493406685 / 2)
    near = lambda d, x, y: math.sqrt(x * y / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    assert got[3, 1].rank_plain == pytest.approx(1 - (1 - near(1, 1.0, 0.4)) * (1 - near(1, 0.4, 0.4)) * (1 - near(2, 0.4, 0.4)))
    assert got[1, 1].dense == pytest.approx(1.0 + 0.4 + 0.4)  # one cover an occurrence


def test_closeness_against_all_pairs():
    rng = np.random.default_rng(3)
    words = [{"positions": np.sort(rng.choice(500, 60, replace=False)), "weights": rng.choice([0.1, 0.4, 1.0], 60)} for _ in range(3)]
    left = 1.0
    for i in range(3):
        for k in range(i):
            for p, x in zip(words[i]["positions"], words[i]["weights"], strict=True):
                for q, y in zip(words[k]["positions"], words[k]["weights"], strict=True):
                    if 0 < abs(p - q) <= postings.FAR:
                        left *= 1 - min(math.sqrt(x * y / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2))), 1 - 1e-15)
    assert postings.closeness(words) == pytest.approx(1 - left)


def test_english_index(spark, tmp_path):
    docs = [(1, "The runners were running happily", ""), (2, "A relational database", ""), (3, "the of and", "")]
    postings.build(spark.createDataFrame(docs, DOCS), str(tmp_path / "p"), analyzer="english")
    said = [(1, "runner"), (2, "run"), (3, "relations"), (4, "the"), (5, '"the runners were running"'), (6, "happily -databases")]
    got = sorted((r.query, r.key) for r in postings.text_ranks(spark, str(tmp_path / "p"), spark.createDataFrame(said, "query long, said string"), "english").collect())
    assert got == [(1, 1), (2, 1), (3, 2), (5, 1), (6, 1)]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"), ("é", "é"), ("a1b2", "a1b2"), ("is", "is")])
def test_stems(word, want):
    assert stem(word) == want


def test_index_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="repeats"):
        postings.build(spark.createDataFrame([(1, "a", ""), (1, "b", "")], DOCS), str(tmp_path / "p"))
    with pytest.raises(ValueError):
        postings.build(spark.createDataFrame([], DOCS), str(tmp_path / "q"), analyzer="latin")
    assert len(STOP_WORDS) == 127 and all(re.fullmatch("[a-z]+", w) for w in STOP_WORDS)


def test_empty_index(spark, tmp_path):
    postings.build(spark.createDataFrame([], DOCS), str(tmp_path / "p"))
    assert postings.text_ranks(spark, str(tmp_path / "p"), spark.createDataFrame([(1, "a")], "query long, said string")).collect() == []
    assert postings.bm25_top(spark, str(tmp_path / "p"), spark.createDataFrame([(1, "a")], "query long, term string"), 3).collect() == []
