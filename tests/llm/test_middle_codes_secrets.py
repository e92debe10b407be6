"""Fill-in-middle, vector codes and secret scans against plain loops, exact sums and planted tokens."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest

from strandline.llm import fim, secret_scan, vector_codes


def plain_middle(doc_id, text, plain=10, spm=20):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(s in t for s in fim.SENTINELS) or h3 % 100 >= 100 - plain:
        return ("plain", None, None, t)
    if h4 % 100 < spm:
        return ("spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return ("psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


TEXTS = [None, "", "a", "<P>", "x<S", "M>y<", "é ü\n\nß", "<M", "tab\tand  two\n", "no end", "<<P>>", "x" * 5000, "\x00nul", "𝔸 b"] + ["wörd, " * k + "\n" * (k % 3) for k in range(1, 60)]


def test_middle_of_odd_texts_against_plain_loop(spark):
    rows = [(None if i == 5 else i // 2, t, "extra") for i, t in enumerate(TEXTS * 3)]
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, output string"))
    got = sorted((str(r.doc_id), r.output, r.form, str(r.prefix_chars), str(r.middle_chars), r.n) for r in made.collect())
    want = sorted((str(i), w[3], w[0], str(w[1]), str(w[2]), len(t or "")) for i, t, _ in rows for w in [plain_middle(i, t)])
    assert got == want and {g[2] for g in got} == {"plain", "psm", "spm"}
    assert all(r.output_sha256 and r.restored_sha256 for r in fim.digest(made).collect())
    assert sorted(r.restored_sha256 for r in fim.digest(made).collect()) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows)
    assert fim.digest(fim.fill_in_middle(spark.createDataFrame([], "doc_id string, text string"))).count() == 0


@pytest.mark.parametrize("unit", fim.UNITS)
def test_rank_lookup_against_every_unit(unit):
    found, rng = fim.automaton(), random.Random(4)
    split = {"chars": r"(?s).", "words": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", "lines": r"[^\n]*\n|[^\n]+"}[unit]
    for _ in range(300):
        t = "".join(rng.choice("ab é\n,<P>") for _ in range(rng.randrange(40)))
        e, ends = fim.Events(t, found), [0] + [m.end() for m in re.finditer(split, t)]
        assert e.units(unit) == len(ends) - 1 and [e.place(r, unit) for r in range(len(ends))] == ends
        assert e.marked == any(s in t for s in fim.SENTINELS)
        assert [e.words_before(p) for p in range(len(t) + 1)] == [len(re.findall(r"\w+", t[:p])) for p in range(len(t) + 1)]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_every_unit_goes_there_and_back(spark, unit):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    marks = ("[pre]", "{suf}", "(mid)")
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, plain=0, spm=50, sentinels=marks)
    back = made.select("doc_id", "form", fim.restored(made.output, made.form, marks).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in rows} and {r.form for r in back} == {"plain", "psm", "spm"}


def test_events_are_taken_in_steps(monkeypatch):
    t = "ab, c\n" * 50
    whole = fim.Events(t, fim.automaton())
    monkeypatch.setattr(fim, "STEP", 7)
    parts = fim.Events(t, fim.automaton())
    assert whole.separators.tolist() == parts.separators.tolist() and whole.ends.tolist() == parts.ends.tolist()


@pytest.mark.parametrize("bad", [{"unit": "bytes"}, {"sentinels": ("a", "a", "b")}, {"sentinels": ("ab", "ba", "x")}, {"sentinels": ("", "b", "c")}])
def test_middle_refuses(spark, bad):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), **bad)


# --- vector codes ----------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(k, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[list(part(v, p)) for _, v, _ in kept[:entries]] for p in range(parts)]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    at = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [at(part(v, p), books[p]) for _, v, _ in kept]
            for e in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), o in zip(kept, own, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for k, v, lab in kept:
        best = [at(part(v, p), books[p]) for p in range(parts)]
        out.append((k, "".join(f"{b:02x}" for b in best), sum(gap(part(v, p), books[p][b]) for p, b in enumerate(best)), lab))
    total = {}
    for *_, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(k, c, e, total[lab], sha) for k, c, e, lab in out]


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def test_codes_against_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, -0.5, rng.gauss(0, 0.3)]) for _ in range(16)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(3, rows[3][1], 2), (None, rows[4][1], 1), (200, None, 1), (201, [None] + [0.1] * 15, 1), (202, [float("nan")] + [0.1] * 15, 1), (203, [float("inf")] + [0.1] * 15, 1)]
    got = vector_codes.digest(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_codes(rows)))


def test_codes_of_few_and_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert vector_codes.digest(make([])).count() == 0
    assert vector_codes.digest(make([(1, None, 1), (2, [], 1)])).count() == 0
    few = [(i, [float(i)] * 8, None) for i in range(3)] * 2
    got = vector_codes.digest(make(few + [(9, [1.0] * 16, 1)])).collect()  # the odd length goes
    assert sorted(map(tuple, got)) == sorted(plain_codes(few)) and {r.error for r in got} == {0}
    with pytest.raises(Exception, match="too large"):
        vector_codes.digest(make([(1, [1e30] * 8, 1)]))
    with pytest.raises(ValueError):
        vector_codes.digest(make([(1, [1.0] * 9, 1)]))


@pytest.mark.parametrize("size", [3, 1000, vector_codes.MOST])
def test_screening_never_loses_the_nearest(size):
    rng = np.random.default_rng(6)
    for _ in range(30):
        book = rng.integers(-size, size + 1, (16, 8))
        book[8:] = np.clip(book[:8] + rng.integers(-1, 2, (8, 8)), -size, size)  # near ties and ties
        x = np.clip(np.concatenate([rng.integers(-size, size + 1, (100, 8)), book, (book[:8] + book[8:]) // 2]), -size, size)
        gap = ((x[:, None] - book[None]).astype(object) ** 2).sum(axis=2)
        best, distance, many = vector_codes.nearest_entries(x, book)
        assert best.tolist() == [int(np.argmin(g)) for g in gap] and distance.tolist() == [min(g) for g in gap] and many > 0


def test_screening_settles_most_rows():
    rng = np.random.default_rng(7)
    x, book = rng.integers(-4000, 4000, (5000, 8)), rng.integers(-4000, 4000, (16, 8))
    assert vector_codes.nearest_entries(x, book)[2] < 50


def test_codes_decode_to_their_entries(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)], 1, "x") for i in range(200)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=32)
    want = {r["key"]: r["error"] for r in coded.collect()}
    for r in vector_codes.decode(coded, books).collect():
        whole = [math.floor(4096 * float(np.float32(x))) for x in rows[r["key"]][1]]
        assert sum((a - round(4096 * b)) ** 2 for a, b in zip(whole, r["vector"], strict=True)) == want[r["key"]]


# --- secrets ---------------------------------------------------------------------------


def plain_base(text):
    t, out = text or "", []
    pattern = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return [("assign", "access", "hex")[k] + f":{s}:{e}" for s, k, e in sorted(out)]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(9)
    bits = ["password", "PASSWD", "Secret", "toKen", "api_key", "APIKEY", "api", "'", '"', " ", ":", "=", "AKIA", "A1" * 9, "0a" * 12, "0a" * 11, "b=c", "x", "ſecret", "K", "é", "abcdef", "\n", "-", "."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(1500)] + [(None, None), (1, "")]
    got = secret_scan.digest(secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = [(i, *(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(spans).encode()).hexdigest()) for i, t in rows for spans in [plain_base(t)]]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want)) and sum(w[1] for w in want) > 50
    for r in got:
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == plain_base(dict(rows[:1500]).get(r.doc_id, "") if r.doc_id != 1 else None) or r.doc_id == 1
    assert secret_scan.secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def prose(rng, n):
    heads = ["ther", "stan", "gel", "con", "mar", "in", "pro", "vis", "tal", "hou"]
    return " ".join("".join(rng.choice(heads) for _ in range(rng.randint(1, 3))).capitalize() if rng.random() < 0.1 else "".join(rng.choice(heads) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_planted_tokens_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(10)
    clean = ["some_long_identifier_of_a_module", "https://example.org/a/long/path/to/some/page-with-words", "CamelCaseNamesOfManyClassesInOneLine", "a" * 40, "ab" * 30, "2024-11-28_10-15-00_report_final", "9807915762804490", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "=" * 50, "-" * 30, "1234567890" * 4]
    made = [base64.b64encode(rng.randbytes(30)).decode(), base64.urlsafe_b64encode(rng.randbytes(24)).decode(), rng.randbytes(20).hex().upper(), base64.b32encode(rng.randbytes(25)).decode(), "".join(rng.choice(secret_scan.ENCODINGS[5][1]) for _ in range(36))]
    rows = [(i, f"{prose(rng, 60)} {clean[i % len(clean)]} {prose(rng, 40)}") for i in range(400)]
    rows += [(1000 + i, f"{prose(rng, 30)} {made[i % 5]} {prose(rng, 30)}") for i in range(50)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [i for i, k in got.items() if i < 1000 and "random" in k]
    assert all(got[1000 + i].count("random") == 1 for i in range(50))


def test_ordinary_text_is_a_distribution():
    rng = np.random.default_rng(13)
    p = np.exp(secret_scan.ordinary(rng.integers(0, 9, (128, 128)).astype(float)))
    assert np.allclose(p[:, secret_scan._TOKEN_BYTE[:128]].sum(axis=1), 1, atol=1e-6)


def test_battery_is_calibrated_on_uniform_ranks():
    rng = np.random.default_rng(11)
    for size in (16, 32, 64):
        for n in (24, 40, 200):
            p = np.array([secret_scan.battery(rng.integers(0, size, n), size) for _ in range(800)])
            assert (p < 0.01).mean(axis=0).max() < 0.035 and np.mean([secret_scan.combined(tuple(x)) < 0.001 for x in p]) < 0.015
    assert min(secret_scan.battery(np.arange(64), 64)) < 1e-6 and min(secret_scan.battery(np.zeros(30, int), 64)) < 1e-6
    assert min(secret_scan.battery(np.tile([0, 63], 30), 64)) < 1e-6
    # known points of the chi-squared distribution
    for x, df, p in [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (2.705543, 1, 0.1), (99.607, 60, 0.001)]:
        assert abs(secret_scan._upper_tail(x, df) - p) < 1e-5


def test_discoveries_follow_the_definition(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        tried = [rng.randint(20, 90) for _ in range(rng.randrange(4))]
        rows.append((i, [], tried, [(0, n, n, rng.gauss(3, 5), "hex", 0.5) for n in tried if rng.random() < 0.7]))
    span = "struct<start: bigint, end: bigint, length: int, evidence: double, encoding: string, p: double>"
    got = secret_scan.thresholds(spark.createDataFrame(rows, f"doc_id long, base array<string>, tried array<int>, found array<{span}>"), 0.05)
    band = lambda n: int(math.log2(n))
    for b in {band(n) for _, _, t, _ in rows for n in t}:
        m = sum(band(n) == b for _, _, t, _ in rows for n in t)
        e = sorted((f[3] for *_, found in rows for f in found if band(f[2]) == b), reverse=True)
        most = max((k for k in range(1, len(e) + 1) if e[k - 1] >= math.log(m / (0.05 * k))), default=0)
        assert (sum(x >= got[b] for x in e) if b in got else 0) == most


def test_pairs_are_those_of_words(monkeypatch, spark):
    texts = ["ab ba", "ab", "x" * 30, None, "é1"] + ["word " * 50] * 3
    whole = secret_scan.pair_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    monkeypatch.setattr(secret_scan, "STEP", 13)
    b = np.frombuffer((" " + " ".join(t or "" for t in texts) + " ").encode(), np.uint8)
    assert (whole.ravel() == secret_scan._pairs(b)).all()
    assert whole[ord("a"), ord("b")] == 2 and whole[ord("x"), ord("x")] == 0 and whole[secret_scan.EDGE, ord("w")] == 150
