"""The training-data operators against brute force, round trips and edge cases."""

import gzip
import hashlib
import itertools
import math
import pathlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, exact_dedup, langid, near_dedup, pack, reshard, substrings, warc
from strandline.llm.common import clear, scratch, word_hashes
from strandline.llm.components import components
from strandline.llm.decontaminate import contaminated, digest, keep_clean
from strandline.llm.token_counts import Counter as TokenCounter
from strandline.llm.token_counts import VOCABULARY, TokenTree, count_edits, vocabulary_of

DOCS = "doc_id long, text string, lang string, source string, node string, h string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_docs(spark):
    """Nulls, empties, ties, repeated rows, a long text and columns with clashing names."""
    long = "Long " * 20000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, long, "en", "a"), (3, long, "en", "a"), (None, "the cat", "en", None), (4, "the cat", "en", "b"), (5, "12 !?", "de", "b"), (6, "é\0\n", None, "a"), (7, None, "en", "a")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_words_match_the_pattern():
    rng = random.Random(1)
    rows = ["", None, "Ab c_d é9", "q" * 600_000, *("".join(rng.choice("ab é,Z\n") for _ in range(rng.randrange(200))) for _ in range(500))]
    hashes, _, _, first = word_hashes(pa.array(rows))
    want = [words(t) for t in rows]
    assert [len(w) for w in want] == [int(b - a) for a, b in zip(first[:-1], first[1:], strict=True)]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip((w for ws in want for w in ws), hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


def brute_contaminated(docs, items):
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            x = words(t)
            n = min(10, len(x))
            for i in range(len(x) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [1000, 7])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(2)
    items = [(i, prose(rng, n, 6)) for i, n in enumerate([25, 12, 10, 3, 1, 14])] + [(10, None), (11, "")]
    docs = [(i, prose(rng, 40, 6) + " " + (rng.choice(items)[1] or "") + " " + prose(rng, 5, 6)) for i in range(40)] + [(100, None), (101, "")]
    got = digest(contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_contaminated(docs, items)


def test_clean_rows_stay_as_they_are(spark):
    items = spark.createDataFrame([(1, "the cat"), (None, None)], "item_id long, text string")
    for block in (1000, 1):
        left = keep_clean(odd_docs(spark), items, block=block)
        assert left.columns == odd_docs(spark).columns and left.count() == 7 and left.filter("text = 'the cat'").isEmpty()
    assert keep_clean(no_docs(spark), items).count() == 0 and keep_clean(odd_docs(spark), items.filter("false")).count() == 9


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "the cat"), (None, "the cat")], "item_id long, text string")
    got = digest(contaminated(odd_docs(spark), items)).collect()
    assert len(got) == 9 and sorted(r.n_hit for r in got)[-2:] == [2, 2] and {r.n_items for r in got} == {0, 2}
    assert contaminated(no_docs(spark), items).count() == 0
    assert contaminated(odd_docs(spark), items.filter("false")).filter("n_hit > 0").count() == 0


def test_near_classes_against_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(12)]
    docs = []
    for b, text in enumerate(base):
        for c in range(6):
            w = text.split()
            for _ in range(c):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            docs.append((10 * b + c, " ".join(w)))
    docs += [(500, "one two"), (501, "one two"), (502, "One, two!"), (503, "one"), (504, None), (505, "")]
    tok = {i: Counter(tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))) if words(t) else Counter() for i, t in docs}
    parent = {i: i for i in tok}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in tok:
        for j in tok:
            both = sum((tok[i] & tok[j]).values())
            if i < j and both and both / sum((tok[i] | tok[j]).values()) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in tok}
    assert Counter(r.class_id for r in got if r.kept) == Counter({find(i): 1 for i in tok})


def test_near_classes_of_odd_rows(spark):
    got = near_dedup.near_classes(odd_docs(spark)).collect()
    assert len(got) == 9 and sum(r.kept for r in got if r.doc_id == 3) == 1
    assert near_dedup.near_classes(no_docs(spark)).count() == 0
    assert near_dedup.keep_one(odd_docs(spark)).columns == odd_docs(spark).columns


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_exact_classes(spark):
    got = exact_dedup.exact_classes(odd_docs(spark), capacity=1, most=4).collect()
    assert len(got) == 9
    empty = [r for r in got if r.doc_id in (1, 2, 7)]
    assert {(r.keep_id, r.group_size) for r in empty} == {(7, 3)} and [r.doc_id for r in empty if r.kept] == [7]
    assert sum(r.kept for r in got if r.doc_id == 3) == 1 and all(r.group_size == 2 for r in got if r.doc_id == 3)
    assert {r.keep_id for r in got if r.doc_id in (None, 4)} == {4}
    assert exact_dedup.exact_classes(no_docs(spark)).count() == 0


def test_exact_classes_of_many_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(400), "hot" if i % 3 == 0 else f"t{rng.randrange(300)}") for i in range(3000)] + [(None, "t1"), (None, "new"), (None, "new")]
    docs = spark.createDataFrame([(*r, "h", "b") for r in rows], "doc_id long, text string, h string, bucket string").repartition(7)
    want = defaultdict(list)
    for i, t in rows:
        want[t].append(i)
    for capacity, most in ((2000, 14), (3, 2), (1, 0)):
        got = exact_dedup.exact_classes(docs, capacity=capacity, most=most).collect()
        assert Counter((r.text_sha256, r.doc_id) for r in got) == Counter((hashlib.sha256(t.encode()).hexdigest(), i) for i, t in rows)
        for t, ids in want.items():
            own = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
            last = max((i for i in ids if i is not None), default=None)
            assert {(r.keep_id, r.group_size) for r in own} == {(last, len(ids))} and [r.doc_id for r in own if r.kept] == [last]
    assert exact_dedup.keep_one(docs).count() == len(want)


def test_directory_covers_all_cells():
    buckets = exact_dedup.directory({0: 100, 1: 5, 15: 7}, capacity=10, most=4)
    cells = sorted(c for first, local in buckets for c in range(first, first + (1 << (4 - local))))
    assert cells == list(range(16)) and (0, 4) in buckets


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "~1 <|end|> ~0~", "<|turn|>user\nx<|end|>", "", None, "a\nb", "<<|", "~"]
    rows = [(1, i, ["user", "assistant", None, "a\n~8b"][i % 4], t) for i, t in enumerate(said)] + [(2, None, "assistant", "x"), (2, None, "assistant", "x"), (None, 2, "gpt", "z"), (None, 6, "human", None)]
    turns = spark.createDataFrame([(*r, "a", "b") for r in rows], "conv_id long, turn long, role string, text string, turns string, layout string")
    canon = chat.canonical(chat.records_of(turns))
    assert {r.layout for r in canon.collect()} == {"turn_row", "messages", "from_value", "role_content"}
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.turns_of(canon))).collect()}
    assert [(t.role, t.text, t.loss) for t in back[1].turns] == [(r[2] or "", r[3] or "", r[2] == "assistant") for r in rows[:8]]
    assert len(back[2].turns) == 2 and [(t.role, t.text) for t in back[None].turns] == [("gpt", "z"), ("human", "")]
    assert chat.render(turns.filter("false")).count() == 0


def test_turns_that_are_no_json_are_kept(spark):
    rows = chat.canonical(spark.createDataFrame([(1, 0, "no json", "user", "kept"), (1, 1, None, None, None)], "conv_id long, turn long, record string, role string, text string"))
    assert sorted(map(tuple, chat.turns_of(rows).collect())) == [(1, 0, "user", "kept"), (1, 1, "", "")]


def test_layouts_by_fingerprint(spark):
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":null}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"output":"a","instruction":"i","input":"x"}', '{"prompt":"q","response":"a"}', '{"strange":1}', "no json", None]
    got = chat.canonical(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [r.layout for r in got] == ["messages", "from_value", "instruction_input", "prompt_response", None, None, None]
    assert [[tuple(t) for t in r.turns] for r in got[:4]] == [[("user", "q"), ("assistant", "")], [("user", "q"), ("assistant", "a")], [("user", "i\n\nx"), ("assistant", "a")], [("user", "q"), ("assistant", "a")]]


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "x" * 300_000)]
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path, per_file=3)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    for k, _, html in rows:
        data = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())


def test_warc_files_are_plain_members_and_roll_by_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "u", "".join(rng.choice("abcdefgh") for _ in range(800))) for i in range(30)] + [(29, "u", "q" * 2000), (40, "u", "q" * 2000), (40, "v", "q" * 2000)]
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame([(*r, 0, 0) for r in rows], "page_id long, url string, html string, sha int, last int").coalesce(1), path, file_bytes=2000)
    files = list(pathlib.Path(path).glob("roll=*/*.txt"))
    assert len(files) > 3
    data = b"".join(gzip.open(f).read() for f in files)
    assert data.count(b"WARC/1.1\r\n") == 33
    got = warc.read(spark, path).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 2000) == {(29, "revisit", 40): 1, (40, "response", None): 2}
    empty = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").filter("false"), empty)


def test_warc_reader_reports_damage():
    data = warc.member(warc.record(1, "u", b"abc", None, hashlib.sha1(b"abc").digest()))
    assert [warc.parse(*r)[-1] for r in warc.records(data + data)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.records(data[:-9]))


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(5)
    for _ in range(20):
        blocks = [(k, c, rng.randrange(1, 60), 0) for k in range(5) for c in range(3)]
        blocks = [(k, c, n, n * 10 ** (c + 1)) for k, c, n, _ in blocks]
        moves = reshard.plan(blocks, 4)
        per = Counter()
        for _, _, lo, hi, shard, _ in moves:
            per[shard] += hi - lo
        assert max(per.values()) - min(per[k] for k in range(4)) <= 1
        moved = sum((hi - lo) * 10 ** (c + 1) for k, c, lo, hi, shard, _ in moves if k != shard)
        # by hand: of each old shard the smallest rows leave, down to its capacity
        least = 0
        for k in range(5):
            leave = sum(n for kk, _, n, _ in blocks if kk == k) - (per[k] if k < 4 else 0)
            for kk, c, n, _ in blocks:
                if kk == k and leave > 0:
                    least += min(leave, n) * 10 ** (c + 1)
                    leave -= min(leave, n)
        assert moved == least


def test_reshard_slots_and_rewrite(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 4).cast("int").alias("old"))
    rows = reshard.assign(docs, "old", shards=6).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sorted(map(len, slots.values())) == [83, 83, 83, 83, 84, 84]
    kept, changed = reshard.rewrite(docs, "old", f"{tmp_path}/s", shards=6)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows)) and changed == list(range(6))
    assert reshard.assign(docs.filter("false"), "old").count() == 0


def test_reshard_moves_the_fewest_bytes(spark, tmp_path):
    rng = random.Random(15)
    for shards in (3, 4):
        rows = [(i, "x" * rng.randrange(0, 3000), rng.choice([0, 0, 0, 1, 2, 3])) for i in range(401)]
        out = reshard.assign(spark.createDataFrame(rows, "doc_id long, text string, old int"), "old", shards=shards).collect()
        moved = sum(len(r.text) + 8 for r in out if r.shard != r.old_shard)
        # by brute force: which shards take a row more; then of each over-full shard the smallest rows leave
        sizes = {k: sorted(len(t) + 8 for _, t, o in rows if o == k) for k in range(4)}
        least, more = divmod(len(rows), shards)
        options = []
        for extra in itertools.combinations(range(shards), more):
            room = {k: least + (k in extra) if k < shards else 0 for k in range(4)}
            options.append(sum(sum(sizes[k][: max(0, len(sizes[k]) - room[k])]) for k in range(4)))
        assert moved == min(options)


def test_reshard_leaves_other_shards_alone(spark, tmp_path):
    rows = [(i, f"t{i}", 0) for i in range(30)] + [(i, "same", 1) for i in range(20)] + [(100, None, 2), (None, None, 2), (100, "a", 2), (100, "a", 2), *((i, "z" * i, 2) for i in range(6))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, old int, shard int, rank int")
    kept, changed = reshard.rewrite(docs, "old", f"{tmp_path}/s", shards=3)
    got = kept.collect()
    assert changed == [0, 2] and sorted(p.name for p in tmp_path.joinpath("s").iterdir() if p.is_dir()) == ["shard=0", "shard=2"]
    assert Counter(r.shard for r in got) == {0: 20, 1: 20, 2: 20} and all(r.shard == 1 for r in got if r.old_shard == 1)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)


def test_passages(spark):
    rng = random.Random(6)
    shared, other = prose(rng, 60, 5000), prose(rng, 80, 5000).split()
    fuzzy = list(other)
    fuzzy[20] = fuzzy[50] = "changed"
    docs = [(i, f"{prose(rng, 150, 5000)} {shared} {prose(rng, 90, 5000)}") for i in range(4)]
    docs += [(10, prose(rng, 70, 5000) + " " + " ".join(other)), (11, " ".join(fuzzy) + " " + prose(rng, 30, 5000))]
    docs += [(20 + i, prose(rng, 300, 5000)) for i in range(5)] + [(30, None), (31, ""), (None, shared)]
    got = substrings.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.match_id) for r in got} == {(1, 0), (2, 0), (3, 0), (11, 10), (None, 0)}
    for r in got:
        assert 58 <= r["last"] - r["first"] + 1 <= 84
    assert substrings.passages(no_docs(spark)).count() == 0


@pytest.mark.parametrize("gap", [40, 80, 150])
def test_passages_on_both_sides_of_a_gap(spark, gap):
    rng = random.Random(gap)
    shared = [prose(rng, 60, 5000) for _ in range(3)]
    docs = [(i, f" {prose(rng, gap, 10**6)} ".join([prose(rng, 30, 10**6), *shared, prose(rng, 30, 10**6)])) for i in range(2)]
    got = sorted(substrings.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda r: r["first"])
    want = [30 + gap + n * (60 + gap) for n in range(3)]
    assert len(got) == 3
    for r, at in zip(got, want, strict=True):
        assert abs(r["first"] - at) <= 2 and abs(r["last"] - at - 59) <= 2 and r.n_matched >= 58


def test_stretches_cover_what_any_pair_of_blocks_spans():
    import numpy as np

    rng = random.Random(9)
    for _ in range(60):
        x, y, a, b = [], [], [], []
        for n in range(7):
            a.append(len(x))
            b.append(len(y))
            same = [rng.randrange(10**6) for _ in range(rng.choice([8, 20, 45, 60]))]
            x, y = x + same, y + same
            x, y = x + [10**7 + rng.randrange(10**6) for _ in range(rng.randrange(1, 40))], y + [10**8 + rng.randrange(10**6) for _ in range(rng.randrange(1, 40))]
        u, v = np.array(x, np.uint32), np.array(y, np.uint32)
        got = substrings.stretches(a, b, u, v, 8, 50, 0.8)
        blocks = substrings._blocks(a, b, u, v, 8)
        for f in range(7):
            for t in range(f, 7):
                size = max(blocks[t][1] - blocks[f][0], blocks[t][3] - blocks[f][2])
                matched = sum(p[4] for p in blocks[f : t + 1])
                if size >= 50 and min(blocks[t][1] - blocks[f][0], blocks[t][3] - blocks[f][2]) >= 50 and matched / size >= 0.8:
                    held = {w for p in got for w in range(p[0], p[1])}
                    assert all(w in held for p in blocks[f : t + 1] for w in range(p[0], p[1]))
        assert all(min(p[1] - p[0], p[3] - p[2]) >= 50 and p[4] / max(p[1] - p[0], p[3] - p[2]) >= 0.8 for p in got)


def test_chains_are_collinear():
    import numpy as np

    rng = random.Random(7)
    a = np.array(sorted(rng.sample(range(500), 60)))
    b = np.array([x + 5 if i % 3 else rng.randrange(500) for i, x in enumerate(a)])
    found = substrings.chains(a, b, 8)
    assert sorted(i for c in found for i in c) == list(range(60))
    assert all(a[i] < a[j] and b[i] < b[j] for c in found for i, j in zip(c, c[1:], strict=False))


def test_token_trees_follow_edits():
    counter, rng = TokenCounter(vocabulary_of(VOCABULARY)), random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("ab  c'd 're \n\n\t 12é中,.!") for _ in range(rng.choice([0, 1, 40, 900])))
        tree = TokenTree(text, counter)
        for _ in range(4):
            a = rng.randrange(len(text) + 2)
            b, new = a + rng.choice([0, 1, 30]), "".join(rng.choice("ab ' 1é\n") for _ in range(rng.choice([0, 1, 6, 300])))
            total = tree.edit(a, b, new)
            lo = min(a, len(text))
            text = text[:lo] + new + text[max(lo, min(b, len(text))) :]
            assert tree.text == text and total == len(counter.encode(text))


def test_long_runs_of_one_kind():
    counter = TokenCounter(vocabulary_of(VOCABULARY))
    for unit in (" ", "a", "7", "é", "\n", "!"):
        tree = TokenTree(unit * 1_000_000, counter)
        assert 0 < tree.total <= 2_000_000 and tree.edit(500_000, 500_001, "x y") > 0


def test_null_edits(spark):
    kind = "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>"
    rows = [(1, "one two", [None, (None, None, "x"), (0, None, None)]), (2, "one", None), (3, None, [(5, 9, "new")])]
    got = {r.doc_id: r for r in count_edits(spark.createDataFrame(rows, kind), edits="edits").collect()}
    assert (got[1].n_chars_after, got[2].n_chars_after, got[3].n_chars_after) == (8, 3, 3)


def test_counts_of_odd_rows(spark):
    got = count_edits(odd_docs(spark)).collect()
    assert len(got) == 9 and all(r.n_tokens == 0 for r in got if r.doc_id in (1, 2, 7)) and all(r.n_tokens == r.n_tokens_after for r in got)
    assert count_edits(no_docs(spark)).count() == 0


def test_packing(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 17}", i % 40 if i % 5 else None, rng.randrange(0, 260)) for i in range(600)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster int, n int")
    got = pack.pack(docs, "n", capacity=100, group=200).collect()
    whole, bins = Counter(), defaultdict(list)
    for r in got:
        whole[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    assert whole == Counter({i: n or 0 for i, _, _, n in rows})
    by = {r[0]: r for r in rows}
    for placed in bins.values():
        placed.sort(key=lambda r: (r.offset, r.length))
        assert sum(r.length for r in placed) <= 100
        assert all(a.offset + a.length <= b.offset for a, b in zip(placed, placed[1:], strict=False))
        for k in (1, 2):
            seen = [by[r.doc_id][k] for r in placed if by[r.doc_id][k] is not None]
            assert len(seen) == len(set(seen))
    assert pack.pack(docs.filter("false"), "n").count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    assert pack.best_fit([60, 50, 40, 30], ["a", "b", "b", "c"], [None] * 4, 100) == [(0, 0), (1, 0), (0, 60), (1, 50)]
    assert pack.best_fit([60, 30, 30], ["a", "a", "b"], [1, 2, 1], 100) == [(0, 0), (1, 0), (1, 30)]


def tightest(lengths, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n and b["room"] and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return out


def test_best_fit_against_every_bin():
    rng = random.Random(10)
    for _ in range(40):
        n = rng.randrange(1, 120)
        lengths = sorted((rng.randrange(0, 101) for _ in range(n)), reverse=True)
        sources, clusters = ([rng.choice([None, *range(k)]) for _ in range(n)] for k in (6, 15))
        assert pack.best_fit(lengths, sources, clusters, 100) == tightest(lengths, sources, clusters, 100)


def test_packing_of_texts(spark):
    rows = [(i, None, None) for i in range(5)] + [(7, "same", "a"), (8, "same", "b"), (9, "same", None), (9, "same", None), (None, "é" * 9000, "a")]
    got = pack.pack_texts(spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, source string, grp int, length int")).collect()
    assert len({r.bin_id for r in got if r.doc_id is not None and r.doc_id < 5}) == 1
    assert len({r.bin_id for r in got if r.doc_id in (7, 8, 9)}) == 4
    assert sum(r.length for r in got if r.doc_id is None) == 18001
    assert pack.pack_texts(no_docs(spark)).count() == 0


def scored(model, text):
    """A text's language by looking every word up anew."""
    total, n = [0.0] * len(model["langs"]), 0
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        pieces = [[word], *([f" {word} "[i : i + o] for i in range(len(word) + 3 - o)] for o in langid.ORDERS)]
        for order, own in zip((0, *langid.ORDERS), pieces, strict=True):
            known = [model["tables"].get(order, {})[p] for p in own if p in model["tables"].get(order, {})]
            if known:
                total = [t + sum(k.get(i, model["missing"]) for k in known) / len(known) for i, t in enumerate(total)]
                n += 1
                break
    return None if not n else [t / n for t in total]


def test_languages_against_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, langid.learnable())
    counts = Counter()
    for r in docs.filter(langid.learnable()).filter("lang IS NOT NULL AND text IS NOT NULL").collect():
        counts.update((r.lang, w) for w in re.findall(r"[^\W\d_]+", r.text.lower()))
    assert {(model["langs"][i], w): v for w, entry in model["tables"][0].items() for i, v in entry.items()} == {k: pytest.approx(math.log(n / sum(m for (lang, _), m in counts.items() if lang == k[0]))) for k, n in counts.items()}
    for r in langid.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = scored(model, r.text or "")
        if want is not None:
            assert want[model["langs"].index(r.lang_pred)] == pytest.approx(max(want))


def test_the_sample_is_the_rows_with_the_least_hash(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANG", 50)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("lang"))
    model = langid.fit(docs, F.lit(True))
    want = {r.text for lang in ("rare", "hot") for r in docs.filter(F.col("lang") == lang).orderBy(F.xxhash64("doc_id")).limit(50).collect()}
    assert set(model["tables"][0]) == want


def test_scratch_is_cleared(spark):
    path = scratch(spark, "x")
    spark.range(1).write.parquet(path)
    before = pathlib.Path(path).exists()
    from strandline.llm import common

    kept, common._made[:] = common._made[:-1], [path]
    assert before and clear(spark) == 1 and not pathlib.Path(path).exists()
    common._made[:] = kept


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, langid.learnable())
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    odd = langid.predict(odd_docs(spark), model).collect()
    assert len(odd) == 9 and all((r.lang_pred, r.score) == ("und", 0.0) for r in odd if r.doc_id in (1, 2, 5, 7))
    assert langid.predict(no_docs(spark), model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs(spark), langid.fit(no_docs(spark), langid.learnable())).collect()} == {"und"}
    assert langid.keep_known(odd_docs(spark), model).columns == odd_docs(spark).columns
