import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from brindle.llm import simhash
from brindle.llm.exact_dedup import drop_copies, exact_dedup
from brindle.llm.graph import components
from brindle.llm.langid import filter_languages
from brindle.llm.mixing import mixed_documents
from brindle.llm.simhash import drop_near_copies, fingerprint, list_links, near_links, position_masks, signed, simhash_components
from brindle.llm.suffix_dedup import _classify, _RUNS_SQL, _unpacked, column_classes, dedup_substrings, packed
from brindle.llm.work import Workspace


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("block", [16, 8192])
def test_exact_dedup(documents, block):
    rows = documents.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    got = exact_dedup(documents, block_bytes=block).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for g in got:
        by[g.text_sha256].append(g)
    for text, ids in groups.items():
        mine = by.pop(hashlib.sha256(text.encode()).hexdigest())
        assert sorted((g.doc_id is None, g.doc_id or 0) for g in mine) == sorted((i is None, i or 0) for i in ids)
        best = min((i is None, i or 0) for i in ids)
        assert {(g.keep_id, g.group_size) for g in mine} == {(None if best[0] else best[1], len(ids))}
        assert [(g.doc_id is None, g.doc_id or 0) for g in mine if g.kept] == [best]
    assert not by


def test_exact_dedup_against_random_blocks(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += texts[:100]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), block_bytes=4).collect()}
    for i, t in enumerate(texts):
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (texts.index(t), texts.count(t), texts.index(t) == i)


def test_drop_copies(documents, empty):
    out = drop_copies(documents)
    assert out.columns == documents.columns
    assert Counter(norm(r.text) for r in out.collect()) == {norm(r.text): 1 for r in documents.collect()}
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


CLASHING = ["__mine", "__sha", "__id", "__n", "__run", "c0", "C1", "digest", "runs", "run", "n", "sha", "own", "gone", "n_chars2", "text_sha256", "source_size"]


def clashing(documents):
    """The same rows with more columns, named as operators might name theirs."""
    from pyspark.sql import functions as F

    return documents.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING))


@pytest.mark.parametrize("stage", [drop_copies, drop_near_copies, mixed_documents, filter_languages])
def test_columns_of_any_name_stay(documents, stage):
    d = clashing(documents)
    got, plain = stage(d), stage(documents)
    assert got.columns == d.columns
    rows = got.collect()
    assert rows and all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in rows for c in CLASHING)
    assert Counter(tuple(r)[: len(documents.columns)] for r in rows) == Counter(map(tuple, plain.collect()))


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(documents):
    for t in [r.text for r in documents.collect()] + ["a", "A b", "a b c", "ÀB c\x0bd", "a b c d"]:
        assert fingerprint(t) == plain_fingerprint(t)
    assert fingerprint(None) == fingerprint(" \n") == 0


def union_find(n, pairs):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_list_links_long_and_short():
    rnd = random.Random(2)
    mask = position_masks(2)[0]
    free = [b for b in range(64) if not mask >> b & 1]
    for n in (2, 40, 400):
        fps = sorted({signed(sum(rnd.getrandbits(1) << b for b in free[:11])) for _ in range(n)})
        v = np.array(fps, np.int64)
        got = list_links(np.zeros(len(v), np.int64), np.ones(len(v), np.int64), v, 2)
        at = {x: i for i, x in enumerate(fps)}
        near = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2]
        assert union_find(len(fps), near) == union_find(len(fps), [(at[a], at[b]) for a, b in got])
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in got)


def test_near_links_lose_none(spark):
    rnd = random.Random(7)
    fps = [rnd.getrandbits(64) for _ in range(80)]
    for f in fps[:60]:
        for _ in range(3):
            for _ in range(rnd.randint(1, 3)):
                f ^= 1 << rnd.randrange(64)
            fps.append(f)
    fps = sorted({signed(f) for f in fps})
    at = {x: i for i, x in enumerate(fps)}
    got = [(at[r.a], at[r.b]) for r in near_links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2]
    assert near and union_find(len(fps), near) == union_find(len(fps), got)


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_components(spark, one_task, monkeypatch):
    import brindle.llm.graph as m

    monkeypatch.setattr(m, "ONE_TASK", one_task)
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 50)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    want = union_find(300, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), Workspace(spark, "t")).collect()}
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Workspace(spark, "t")).count() == 0


def test_simhash_components(spark, documents, empty):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base[:150], "other", *base[151:]]), " ".join(base).upper(), "some thing else", None, "", " "]
    d = spark.createDataFrame([(i * 10, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    fps = [plain_fingerprint(t) for t in texts]
    want = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    got = {r.doc_id: r for r in simhash_components(d).collect()}
    assert [got[i * 10].component_id for i in range(len(texts))] == [w * 10 for w in want]
    assert [got[i * 10].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    odd = simhash_components(documents).collect()
    assert len(odd) == documents.count() and {r.component_id for r in odd if r.doc_id in (4, 5, 6)} == {4}
    kept = drop_near_copies(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {1, 4, 7, 8, 9, 10}
    assert simhash_components(empty).count() == 0 and drop_near_copies(empty).count() == 0


def test_similar_copies_go_and_others_stay(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, base = {}, {}
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(60, 400))
        base[i * 100] = words
        docs[i * 100] = words
        for k in range(1, 4):  # copies with a few other words
            copy = list(words)
            for at in rnd.sample(range(len(copy)), max(1, len(copy) // 80)):
                copy[at] = rnd.choice(vocabulary)
            docs[i * 100 + k] = copy

    def jaccard(a, b):
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return len(a & b) / len(a | b)

    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string")
    kept = {r.doc_id for r in drop_near_copies(d).collect()}
    assert set(base) <= kept
    due = {i for i, w in docs.items() if i not in base and jaccard(w, base[i // 100 * 100]) >= 0.85}
    assert len(due) > 60 and len(due & kept) <= 0.05 * len(due)
    far = {i for i, w in docs.items() if i not in base and all(jaccard(w, docs[j]) < 0.7 for j in docs if j // 100 == i // 100 and j != i)}
    assert far <= kept


def brute_spans(texts, length):
    seen, out = set(), []
    for raw in texts:
        hit = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                hit[s : s + length] = True
            seen.add(w)
        out.append(hit)
    return out


@pytest.mark.parametrize("length,letters", [(100, "abcdefgh "), (20, "ab"), (20, "abcdefgh ")])
def test_substrings_against_brute_force(spark, length, letters, monkeypatch):
    import brindle.llm.suffix_dedup as m

    rnd = random.Random(length)
    passages = ["".join(rnd.choices(letters, k=rnd.randint(length - 5, 3 * length))) for _ in range(8)]
    texts = []
    for _ in range(120):
        t = "".join(rnd.choices(letters, k=rnd.randint(0, 2 * length)))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            t += (p if rnd.random() < 0.5 else p[a:]) + "".join(rnd.choices(letters, k=rnd.randint(0, length)))
        texts.append(t)
    texts += texts[:10] + ["é漢" * length, "é漢" * length + "x", "a" * (5 * length), None, ""]
    raws = [(t or "").encode() for t in texts]
    want = brute_spans(raws, length)
    for large in (m.LARGE, 4, 1):  # also with collections that are split, once and twice
        monkeypatch.setattr(m, "LARGE", large)
        got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), length).collect()}
        for i, (raw, hit) in enumerate(zip(raws, want)):
            kept = bytes(np.frombuffer(raw, np.uint8)[~hit])
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), hit.sum(), hashlib.sha256(kept).hexdigest())
            assert r.n_spans == int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())


def test_substrings_of_odd_rows(documents, empty):
    got = dedup_substrings(documents).collect()
    assert len(got) == documents.count() and dedup_substrings(empty).count() == 0
    whole = [r for r in got if r.doc_id == 3]
    assert sum(r.n_removed == r.n_bytes for r in whole) == 2  # both rows of the text that document 1 has; the one with line breaks stays
    assert all(r.n_removed == 0 for r in got if r.doc_id in (4, 5, 6, 9, 10))
    assert next(r for r in got if r.doc_id == 8).n_spans == 1


def test_classify_in_small_batches(spark):
    """The same kinds whatever the batches, also where a collection goes over many."""
    rnd = random.Random(1)
    # rows that are marked repeats beforehand have keys of their own
    rows = [(rnd.randrange(40) if rnd.random() < 0.7 else 1000 + i, rnd.randrange(3), rnd.randrange(1000), i, 1, 0, 0) if rnd.random() < 0.8 else (10_000 + i, 0, 5, i, 1, 0, 1) for i in range(400)]
    want = {}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for mine in by.values():
        firsts = {}
        for r in sorted((r for r in mine if r[6] == 0), key=lambda r: (r[1], r[2], r[3])):
            firsts.setdefault(r[1], r)
        for r in mine:
            if r[6] == 1 or firsts[r[1]] != r:
                want[r[3]] = 1
            elif len(firsts) > 1:
                want[r[3]] = 2
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            runs = spark.createDataFrame([(*r[:3], packed(*r[3:])) for r in rows], _RUNS_SQL)
            got = {r["first"]: r.kind for r in _unpacked(_classify(runs)).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_column_classes_are_a_suffix_order():
    rnd = np.random.default_rng(0)
    symbols = rnd.integers(0, 2, (60, 12)).astype(np.uint16)
    group = np.sort(rnd.integers(0, 5, 60))
    for column, order, starts in column_classes(symbols, group, 4):
        keys = [(group[i], *symbols[i, column:]) for i in order]
        assert keys == sorted(keys)
        classes = [(group[i], *symbols[i, column : column + 4]) for i in order]
        assert starts.tolist() == [k for k in range(60) if k == 0 or classes[k] != classes[k - 1]]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def changed(rnd, words, times):
    words = list(words)
    for at in rnd.sample(range(len(words)), times):
        words[at] = f"n{rnd.getrandbits(40)}"
    return words


def test_similar_pairs_at_the_threshold_lose_none(spark):
    rnd = random.Random(11)
    pairs = []
    while len(pairs) < 150:
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(100, 400))]
        a, b = " ".join(words), " ".join(changed(rnd, words, len(words) // 45))
        if 0.8 <= jaccard(a, b) < 0.85:
            pairs.append((a, b))
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id bigint, text string")
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    lost = sum(2 * i + 1 in kept for i in range(len(pairs)))
    assert lost == 0, f"{lost} of {len(pairs)} pairs are not found"
    assert {2 * i for i in range(len(pairs))} <= kept


@pytest.mark.parametrize("block", [512, 3])
def test_a_family_of_near_copies_keeps_all_its_links(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(12)
    texts = []
    for _ in range(8):
        base = [f"w{rnd.randrange(5000)}" for _ in range(220)]
        texts += [" ".join(changed(rnd, base, rnd.choice((2, 3, 4, 5)))) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fps = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2 or i // 25 == j // 25 and jaccard(texts[i], texts[j]) >= 0.8]
    want = union_find(len(texts), pairs)
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert len(set(want)) > 8 and kept == set(want)
