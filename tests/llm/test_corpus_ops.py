"""Near-duplicates, scores, packing, decontamination and fingerprints against brute force on small tables."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

from incognita.llm import common, decontaminate, fingerprint, language_id, lm_score, near_dedup, packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, block string, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    return duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent,hot", [(3, 85, 200), (5, 80, 200), (3, 85, 5)])
def test_near_duplicates_equal_brute_force(spark, width, percent, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([2, 6, 60, 200]))]
        for _ in range(draw.choice([1, 3, 14])):
            copy = [draw.choice(vocabulary) if draw.random() < 0.03 else w for w in base]
            rows.append((len(rows) * 7 + g, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One"), (5004, "one"), (5005, "ONE two"), (5006, rows[0][1].upper()), (5007, "È"), (5008, "è")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of(spark, rows), width, percent).collect()}
    assert found == brute_components(rows, width, percent)


def test_a_large_near_copy_group_is_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(near_dedup, "CELL", 20)
    draw = random.Random(8)
    base = [f"w{draw.randrange(3000)}" for _ in range(90)]
    rows = []
    for i in range(500):
        copy = list(base)
        for _ in range(draw.choice([1, 2, 3, 5, 9])):
            copy[draw.randrange(90)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of(spark, rows), 3, 85).collect()}
    assert found == brute_components(rows, 3, 85)


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")]
    found = sorted(map(tuple, near_dedup.near_duplicates(docs_of(spark, rows), 3, 85).collect()), key=str)
    assert found == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)
    assert near_dedup.near_duplicates(docs_of(spark, []), 3, 85).count() == 0


def test_rows_that_repeat_an_id_are_told_apart(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (1, a + " more"), (1, b), (1, b), (1, ""), (1, None), (5, b + " more"), (0, c), (2, c), (2, d), (3, c), (3, c), (None, a)]
    kept = sorted(map(tuple, near_dedup.clean(docs_of(spark, rows).repartition(3)).select("doc_id", "text").collect()), key=str)
    ones = [t for i, t in kept if i == 1]
    assert len(ones) == 3 and b in ones and len({a, a + " more"} & set(ones)) == 1 and len({"", None} & set(ones)) == 1
    assert [x for x in kept if x[0] != 1] == sorted([(0, c), (2, d), (None, a)], key=str)


def test_filters_leave_clashing_columns_alone(spark):
    rows = [(1, "the and of that with this", "en", "s", 5, "a", True, 7), (1, "the and of that with this", "en", "s", 5, "a", True, 7), (2, "the and of that with this", "en", "s", 5, "b", None, 8), (3, "12", "en", "s", 5, None, False, None), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, kept boolean, rejected long")
    items = spark.createDataFrame([(1, "x y z", "t")], "item_id long, text string, kept string")
    kept = near_dedup.clean(docs)
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
    assert {r.doc_id for r in language_id.clean(docs).collect()} == {1, 2}
    assert decontaminate.clean(docs, items).count() == 5 and decontaminate.clean(docs, items).columns == docs.columns


def test_estimates_follow_the_similarity():
    import numpy as np

    draw = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        a = draw.integers(1, 2**63, 2000, dtype=np.uint64)
        k = int(2000 * 2 * share / (1 + share) / 1)
        b = np.concatenate([a[: k // 1][:k], draw.integers(1, 2**63, 2000 - k, dtype=np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        m = near_dedup.minima(np.concatenate([np.sort(a), np.sort(b)]), np.array([2000, 2000]), 640)
        low = m & 15
        e = float((low[0] == low[1]).mean())
        assert abs((e - 1 / 16) / (15 / 16) - true) < 0.07


def plain_model(rows):
    """(base, model) scores by id, from dictionaries of counts."""
    counts = collections.Counter()
    sequence = lambda t: ["<s>", *words(t), "</s>"]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            s = sequence(t)
            counts["<s>",] += 1
            counts.update(tuple(s[k - n + 1 : k + 1]) for k in range(1, len(s)) for n in range(1, min(k + 1, lm_score.ORDER) + 1))
    uni = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != "<s>"}
    n, v, once = sum(uni.values()), len(uni), sum(1 for c in uni.values() if c == 1)
    u0 = (once + 1) / (n + once + 1)

    def chance(history, w):
        if not history:
            return (1 - u0) * uni[w] / n if w in uni else u0
        shorter, c = chance(history[1:], w), counts[history]
        if not c:
            return shorter
        b = lm_score.DISCOUNT / c ** lm_score.FADE[len(history) + 1]
        return (1 - b) * counts[(*history, w)] / c + b * shorter

    out = {}
    for i, t in rows:
        s = sequence(t)
        base = sum(math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for w in s[1:])
        score = sum(math.log10(chance(tuple(s[max(0, k - lm_score.ORDER + 1) : k]), s[k])) for k in range(1, len(s)))
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(s) - 1, sum(w in uni for w in s[1:]), n, base, score)
    return out


@pytest.mark.parametrize("block_bytes,fan", [(6 << 20, 256), (20_000, 256), (6_000, 3)])
def test_scores_equal_a_plain_model(spark, corpus, monkeypatch, block_bytes, fan):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lm_score, "FAN", fan)
    rows = [*corpus[:60], (1000, None), (1001, ""), (1002, "the the unseenword"), (1003, corpus[3][1]), (1004, corpus[4][1] + " end"), (1005, "a b " * 3000), (1006, "x a b " * 20)]
    found = {r.doc_id: r for r in lm_score.score(docs_of(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, (*facts, base, total) in plain_model(rows).items():
        r = found[i]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == facts
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, total, rel_tol=1e-9), i


def test_scores_of_edge_tables(spark):
    assert lm_score.score(docs_of(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    one = lm_score.score(docs_of(spark, [(held, "a b")])).first()
    assert (one.train_tokens, one.n_known, one.n_tokens) == (0, 0, 3) and one.score == 0.0
    same = lm_score.score(docs_of(spark, [(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b"), (5, None)])).collect()
    assert len(same) == 5 and len({r.score for r in same if r.n_tokens == 3}) == 1


def test_messages_are_read_back():
    import numpy as np

    arrays = [np.array([], np.int64), np.array([0, 1, 255, 256]), np.array([2**64 - 1, 3], np.uint64), np.array([True, False])]
    assert [a.tolist() for a in lm_score._read(lm_score._written(arrays))] == [[int(x) for x in a] for a in arrays]
    for blocks, levels in ((1, 1), (256, 1), (257, 2), (65536, 2), (65537, 3)):
        tree = lm_score.Tree(blocks, 256)
        assert tree.levels == levels and tree.fan <= lm_score.FAN and tree.fan**levels >= blocks // 2


def test_the_model_tells_documents_that_occur_twice(spark):
    df = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not held_out")
    times = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "count(*) over (partition by text) as times")
    r = df.join(times, "doc_id").selectExpr("times > 1 as twice", "score / n_tokens as s").collect()
    once, twice = sorted(x.s for x in r if not x.twice), [x.s for x in r if x.twice]
    assert sum(s > once[int(0.9 * len(once))] for s in twice) >= 0.5 * len(twice)


def test_the_model_beats_the_base_on_held_out_documents(spark):
    r = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert r.s > r.b


def check_packing(rows, found, path):
    plain, by_doc, by_seq = Tokenizer.from_file(path), collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        whole = plain.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(whole)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in whole[at : at + r.length]))
            at += r.length
        assert at == len(whole)
    short = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        short += at < 2048
    assert short <= 1


def test_packing_keeps_every_token_once(spark, corpus):
    rows = [*corpus, (9000, None), (9001, ""), (9002, "<|endoftext|> é́ x" * 2000), (9005, "a <|endoftext|>b.<|startoftext|>. c"), (9006, "<|endoftext|>"), (9007, "<|ENDOFTEXT|> A.<|endoftext|>"), (9008, ("w" * 90 + " ") * 300), (9003, "don't. It's, a,b. c.\u0301 &&&, 12. X., ÀB. o\u0308. end."), (9004, "\u0301a.\x0bb,\x1cc")]
    path = queries.word_bpe()
    check_packing(rows, packing.pack(docs_of(spark, rows).repartition(7), path).collect(), path)
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_long_texts_are_encoded_in_pieces(corpus, monkeypatch):
    import time

    monkeypatch.setattr(packing, "AT_ONCE", 50)
    path, plain = queries.word_bpe(), Tokenizer.from_file(queries.word_bpe())
    texts = [*(t for _, t in corpus[:20]), "a, b.  c." * 50, "x" * 500 + " y. " + "z" * 400, ". " * 80, "", None, " <|endoftext|> " * 20]
    assert [len(x) // 4 for x in packing.Encoder(path).encode(texts)] == [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(packing, "CACHED", 300)
    small = packing.Encoder(path)
    for t in texts:
        assert small.encode([t])[0] == b"".join(i.to_bytes(4, "little") for i in plain.encode(t or "", add_special_tokens=False).ids)
    began, packer = time.time(), packing.Packer()
    packer.add(1, 0, b"abcd" * 20_000_000, 20_000_000)
    assert time.time() - began < 5 and sum(len(p[0][2]) for p in packer.take()) + len(packer.open[0][1][0][2]) == 80_000_000


def test_packing_merges_leftovers_level_by_level(spark, corpus, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    path = queries.word_bpe()
    check_packing(corpus[:40], packing.pack(docs_of(spark, corpus[:40]).repartition(9), path).collect(), path)


def test_decontamination_equals_exact_containment(spark):
    draw = random.Random(5)
    items = [(k, " ".join(draw.choice("abcdefghijklmnopqrst") + str(draw.randrange(40)) for _ in range(n))) for k, n in enumerate([3, 5, 9, 30, 80, 300])]
    items += [(6, None), (7, ""), (8, " \n"), (None, "x y z")]
    rows = []
    for k in range(60):
        it = (draw.choice(items[:6])[1]).split()
        cut = [w if draw.random() > draw.choice([0, 0.01, 0.03, 0.1]) else "zz" for w in it]
        rows.append((k, " ".join(["pad"] * draw.randrange(3) + cut + ["tail"] * draw.randrange(3))))
    rows += [(100, None), (101, ""), (102, items[0][1].upper()), (103, items[3][1] + " " + items[4][1]), (None, items[3][1])]
    expected = set()
    for i, t in rows:
        for j, x in items:
            s = shingle_set(x, 5)
            if i is not None and j is not None and s and len(s & shingle_set(t, 5)) >= 0.8 * len(s):
                expected.add((i, j, len(s & shingle_set(t, 5)), len(s)))
    table = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contained(docs_of(spark, rows), table).collect()}
    assert found == expected and len(found) > 20
    kept = {r.doc_id for r in decontaminate.clean(docs_of(spark, rows), table).collect()}
    assert kept == {i for i, _ in rows} - {e[0] for e in expected}
    assert decontaminate.contained(docs_of(spark, []), table).count() == 0
    assert decontaminate.contained(docs_of(spark, rows), table.limit(0)).count() == 0


def test_rows_that_repeat_ids_are_one_document_or_item(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(20)) for p in "ab")
    items = spark.createDataFrame([(1, a), (1, b), (2, a), (2, a)], "item_id long, text string")
    docs = docs_of(spark, [(1, f"x {a} y"), (1, f"x {b} y"), (2, a), (2, a), (3, b)])
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contained(docs, items).collect()}
    assert found == {(1, 1, 32, 32), (1, 2, 16, 16), (2, 2, 16, 16)}
    long = docs_of(spark, [(1, "pad " * 400_000 + a)])
    assert [(r.doc_id, r.item_id) for r in decontaminate.contained(long, items).collect()] == [(1, 2)]


def test_fingerprints_of_edited_texts(spark, corpus, monkeypatch):
    monkeypatch.setattr(fingerprint, "STRETCH", 9)
    rows = [*corpus, (9000, None), (9001, ""), (9002, "a"), (9003, "a b c d e f g")]
    found = {r.doc_id: r for r in fingerprint.edit_likeness(docs_of(spark, rows).repartition(5)).collect()}
    assert len(found) == len(rows)
    texts = [t or "" for _, t in rows]
    for (i, _), t, following in zip(rows, texts, [*texts[1:], texts[0]]):
        k = len(t) // 4
        changed, r = t[: len(t) - k] + following[:k], found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        own, other, after = (fingerprint.sketch([x])[0] for x in (t, changed, following))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.write(own), fingerprint.write(other))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, other), fingerprint.likeness(own, after))
        a, b = shingle_set(t, 5), shingle_set(changed, 5)
        if len(a) > 400:
            assert abs(r.near_edited - len(a & b) / min(len(a), len(b))) < 0.15
        elif 0 < len(a) <= fingerprint.FEW and 0 < len(b) <= fingerprint.FEW:
            assert r.near_edited == len(a & b) / min(len(a), len(b))


def test_fingerprint_edge_rows_and_merging(spark):
    assert fingerprint.edit_likeness(docs_of(spark, [])).count() == 0
    one = fingerprint.edit_likeness(docs_of(spark, [(4, "x y z")])).first()
    assert (one.near_edited, one.near_next) == (1.0 if one.edited_fingerprint == one.fingerprint else 0.0, 1.0)
    several = fingerprint.edit_likeness(docs_of(spark, [(None, "a b"), (None, "c d"), (3, "e f"), (3, "e f")])).collect()
    assert len(several) == 4 and sum(r.doc_id is None for r in several) == 2
    a, b = (" ".join(f"{p}{i}" for i in range(300)) for p in "uv")
    left, right, both = fingerprint.sketch([a, b, f"{a} {b}"])
    merged = fingerprint.merge(left, right)
    assert fingerprint.likeness(merged, both) == 1.0 and abs(len(merged) - len(both)) < 5
    assert (fingerprint.read(fingerprint.write(both)) == both).all()


def test_sketches_of_unequal_documents_are_compared_where_both_are_whole():
    words_of = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    short, long, other = fingerprint.sketch([words_of("a", 40), f"{words_of('b', 3000)} {words_of('a', 40)} {words_of('c', 3000)}", words_of("d", 40)])
    assert len(short) == 36 and len(long) < 2000 and fingerprint.likeness(short, long) == 1.0 and fingerprint.likeness(other, long) == 0.0
    assert fingerprint.likeness(short, other) == 0.0 and fingerprint.likeness(short, short) == 1.0
    parts = fingerprint.sketch([words_of("a", 50), words_of("b", 50), words_of("e", 5)])
    whole = fingerprint.merge(fingerprint.merge(parts[0], parts[2]), parts[1])
    assert len(whole) < 93 and fingerprint.likeness(whole, fingerprint.merge(*parts[:2])) == 1.0
    assert (fingerprint.merge(parts[0], fingerprint.sketch([""])[0]) == parts[0]).all()


def test_rows_of_one_id_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "STRETCH", 20)
    texts = [f"text number {i} of some" for i in range(300)]
    rows = [(None, t) for t in texts[:150]] + [(7, t) for t in texts[150:]] + [(7, texts[299])] * 3
    found = fingerprint.edit_likeness(docs_of(spark, rows).repartition(5))
    assert found.count() == len(rows) and found.where("doc_id is null").count() == 150
    assert found.where("edited_sha256 is null or near_next is null").count() == 0


def test_the_plan_of_many_documents_is_small(spark):
    docs = spark.range(1_000_000).selectExpr("id as doc_id", "concat('w', id) as text")
    found = fingerprint.edit_likeness(docs)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 2_000_000
    assert found.where("near_next < 0").count() == 0


def test_words_are_runs_without_ascii_space():
    texts = ["A b\tC\x1cd", "", None, " x  ", "É é"]
    h, n = common.word_hashes(texts, bytes_at_once=8)
    assert n.tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(h.tolist())) == len(set(flat))
