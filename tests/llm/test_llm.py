"""The training-data operators: brute force, round trips, and odd inputs."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from seqloom.llm import capfilters, chat, jaccard, mixing, packing, quality, queries, secretscan, suffixtree, topk, urlgraph
from seqloom.llm.words import hashed_words, shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key long, key string, id long, n int"


def words(t):
    return WORD.findall((t or "").encode().translate(LOW))


def corpus(seed=0, n=60):
    """Texts with copies, near copies, empties, nulls, a long one and repeated rows."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghijÉßZ,") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice((1, 2, 5, 12, 60, 150)))) for _ in range(n)]
    texts += [texts[7], texts[8].upper(), texts[9] + " end", "", None, "   ", "\n\tx\x0b", " ".join(vocab * 12)]
    base = " ".join(rnd.choice(vocab) for _ in range(200)).split()
    for i in range(12):
        w = list(base)
        w[rnd.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    rows = [(i, t, "en", rnd.choice(["a", "b", "ü", None]), len(t or ""), 1, "k", 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[4], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_shingles():
    import pyarrow as pa

    texts = [r[1] for r in corpus()]
    h, counts = hashed_words(pa.array(texts).slice(2))
    want = [words(t) for t in texts[2:]]
    assert counts.tolist() == [len(w) for w in want]
    assert len(set(zip(h.tolist(), [w for d in want for w in d]))) == len(set(h.tolist())) == len({w for d in want for w in d})
    for k in (1, 3, 5):
        _, n = shingles(h, counts, k)
        assert n.tolist() == [len({tuple(d[i : i + k]) for i in range(max(1, len(d) - k + 1))}) if d else 0 for d in want]


def jaccard_brute(rows, k, num, den):
    sets = [frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset() for w in (words(r[1]) for r in rows)]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and inter * den >= num * (len(sets[i]) + len(sets[j]) - inter):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    ids = collections.defaultdict(list)
    for r, c in zip(rows, comp):
        if r[0] is not None:
            ids[c].append(r[0])
    return sorted((r[0] if r[0] is not None else -1, len(s), min(ids[c]) if ids[c] else -1) for r, s, c in zip(rows, sets, comp))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_equals_brute_force(docs, k, num):
    got = jaccard.linked(docs, k, num, 100).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == jaccard_brute([tuple(r) for r in docs.collect()], k, num, 100)


def test_jaccard_keeps_one_of_each(docs, none):
    kept = jaccard.first_of_each(docs, 5, 80, 100).collect()
    brute = jaccard_brute([tuple(r) for r in docs.collect()], 5, 80, 100)
    with_words = lambda rows: sorted(r for r in rows if words(r[1]))
    want = {d for d, _, c in brute if d == c and d >= 0}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert len(with_words([(str(r.doc_id), r.text) for r in kept])) == len({c for _, n, c in brute if n})
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in jaccard.first_of_each(unique, 5, 80, 100).collect()) == sorted(want)
    assert jaccard.linked(none).count() == jaccard.first_of_each(none).count() == 0


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    """Ids with several texts lose no link, and no text that differs is dropped."""
    rnd = random.Random(11)
    rows = [r for r in corpus(12, 25)]
    base = [f"w{i}" for i in range(201)]
    near = [*base[:-1], "other"]
    rows += [(3, "a text of its own stands here", *rows[0][2:]), (500, rows[3][1], *rows[0][2:]), (500, " ".join(base), *rows[0][2:]), (501, " ".join(near), *rows[0][2:]), (None, " ".join([*near[:-2], "x", "y"]), *rows[0][2:])]
    rows += [(rnd.randrange(25), rows[rnd.randrange(25)][1], *rows[0][2:]) for _ in range(20)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for k, num in ((3, 90), (5, 80)):
        got = jaccard.linked(df, k, num, 100).collect()
        brute = jaccard_brute(rows, k, num, 100)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == brute
    assert (501, 199, 500) in jaccard_brute(rows, 3, 90, 100)
    sets = {}
    for r in jaccard.first_of_each(df, 1, 100, 100).collect():  # equal sets of words only
        key = frozenset(words(r.text))
        assert not key or key not in sets
        sets[key] = r.doc_id
    assert set(sets) - {frozenset()} == {frozenset(words(r[1])) for r in rows} - {frozenset()}
    first = collections.defaultdict(list)
    for r in rows:
        first[frozenset(words(r[1]))].append(r[0])
    assert all(d == min((x for x in first[key] if x is not None), default=None) for key, d in sets.items() if key)


def test_subsets_cover_every_small_pair():
    for num in (60, 80, 90):
        for b in range(1, 14):
            for a in range(1, b + 1):
                need = jaccard.least(num, 100, b)
                if need <= a:
                    assert need in jaccard.subset_sizes(a, num, 100) and need in jaccard.subset_sizes(b, num, 100)


def test_mixing(docs, none):
    rows = mixing.taken(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted((str(r.doc_id), len(words(r.text))) for r in docs.collect())
    src = collections.Counter()
    for r in docs.collect():
        src[r.source] += len(words(r.text))
    order = sorted(src, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([(s, src[s]) for s in order])))
    assert math.isclose(sum(want.values()), min(1.5, 2) * sum(src.values()), rel_tol=1e-9)
    for s in order:
        mine = [r for r in rows if r.source_size == src[s] and math.isclose(r.target, want[s])]
        assert abs(sum(r.taken for r in mine) - want[s]) <= 2 * mixing.BLOCK
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(docs).collect()))
    assert mixing.taken(none).count() == 0


def test_mixed_texts_hold_the_words_taken(docs):
    got = collections.Counter()
    for r in mixing.mixed(docs).collect():
        got[r.doc_id] += len(words(r.text))
    want = collections.Counter()
    for r in mixing.taken(docs).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_permutations_are_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 50, 1000, 10_007, 40_401):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    encode = Tokenizer.from_file(path)
    rows = packing.packed(docs, path).collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append([*encode.encode(r.text or "", add_special_tokens=False).ids, 2])
    by_seq, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[(r.doc_id, r.row_key)].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert len(by_doc) == docs.count()
    for (doc, _), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = next(x for x in texts[doc] if len(x) == pieces[0].doc_tokens)
        data = np.array(ids, "<u4").tobytes()
        assert sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    assert packing.packed(none, path).count() == 0


def test_word_bytes_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    whole, ours = Tokenizer.from_file(path), packing.tokenizer_bytes(path)
    rnd = random.Random(4)
    parts = ["a", "B", "é", "É", "é", "İ", "ß", " ", "\n", "\x1c", "\xa0", "'s", "'", "1", "½", "!", "##", "<|endoftext|>", "<|ENDOFTEXT|>", "ﬁ", "日", "·", "×", "_"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert ours(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_every_character_gets_the_tokenizers_ids():
    """Each character behind capitals that marks join with, in front of a letter, and in a word with signs."""
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    whole, ours = Tokenizer.from_file(path), packing.tokenizer_bytes(path)
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or unicodedata.combining(chr(c)))]
    texts = [f"T{c} {c}A Y{c}{c}b H{c}'s W{c}J{c}. x\n{c} {c}" for c in chars]
    for lo in range(0, len(texts), 2000):
        part = texts[lo : lo + 2000]
        for t, e in zip(part, whole.encode_batch(part, add_special_tokens=False)):
            assert ours(t) == np.array(e.ids, "<u4").tobytes(), t


def test_schedule_uses_every_class_exactly():
    rnd = random.Random(1)
    hist = {c: rnd.randrange(1, 60) for c in rnd.sample(range(1, 129), 70)}
    used = collections.Counter()
    for combo, n in packing.schedule(hist, 128, 3):
        assert sum(combo) <= 128
        for c in combo:
            used[c] += n
    assert used == collections.Counter(hist)


def test_chat_round_trip(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    rnd = random.Random(2)
    parts = ["<|", "<&|", "<&&|", "|", "<", "&", "<|end|>\n", "<|turn|>", "\n", "é", "日本", "😀", " ", "  ", "a", "<|endoftext|>", "\\", ""]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "a\nb\\n<|x"]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) if rnd.random() < 0.9 else None, "x") for c in [*range(30), None] for t in range(rnd.randint(1, 6))]
    rows += [rows[0], (5, None, "assistant", "late", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(5)
    for segment in (chat.SEGMENT, 40):
        got = {r.conv_id: r for r in chat.digests(chat.formatted(df, path, segment=segment)).collect()}
        groups = collections.defaultdict(list)
        for c, t, role, text, _ in rows:
            groups[c].append((t is not None, t or 0, role or "", text or ""))
        assert set(got) == set(groups)
        for c, turns in groups.items():
            turns.sort()
            all_, loss = hashlib.sha256(), "".join(x for *_, r, x in turns if r == "assistant")
            for *_, role, text in turns:
                all_.update(f"{role}\n{text}\n".encode())
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), all_.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole, cut = ({(r.conv_id, r.segment): r for r in chat.formatted(df, path, segment=n).collect()} for n in (chat.SEGMENT, 40))
    assert len(cut) > len(whole)
    for c in set(got):
        parts = [cut[k] for k in sorted(cut, key=str) if k[0] == c]
        parts.sort(key=lambda r: r.segment)
        assert sum((r.ids for r in parts), []) == whole[c, 0].ids and sum((r.mask for r in parts), []) == whole[c, 0].mask
    assert chat.formatted(df.limit(0), path).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 24))
    y = x[:150] + 0.3 * rng.normal(size=(150, 24)) * rng.uniform(0, 1, (150, 1))
    allx = np.vstack([x, y, x[:20], x[5:6] * 3])
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 400 % 3), "x") for i, v in enumerate(allx)]
    n = len(rows)
    rows += [(n, None, 0, "x"), (n + 1, [0.0] * 24, 0, "x"), (n + 2, [float("nan")] * 24, 0, "x"), (n + 3, [1.0, None], 1, "x"), (n + 4, rows[0][1], None, "x"), (n + 5, [float("inf")] * 24, 1, "x"), (None, rows[1][1], 1, "x"), (n + 6, rows[7][1][:10], 1, "x")]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, rep string"


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def test_near_dedup_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: r for r in capfilters.linked(df).collect()}
    ok = [r for r in rows if r[0] is not None and r[2] is not None and usable(r[1]) and any(r[1])]
    x = np.array([r[1] + [0.0] * (24 - len(r[1])) for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in ok])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    assert {r[0]: n - 1 for r, n in zip(ok, near.sum(1).tolist())} == {r[0]: got[r[0]].n_links for r in ok}
    comp = {r[0]: r[0] for r in ok}
    for i, j in zip(*np.nonzero(near)):
        a, b = comp[ok[i][0]], comp[ok[j][0]]
        comp = {k: min(a, b) if c in (a, b) else c for k, c in comp.items()}
    assert {k: got[k].component_id for k in comp} == comp
    others = {r[0] for r in rows} - set(comp)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in others)
    assert len(got) == len(rows) and capfilters.linked(df.limit(0)).count() == 0


def test_chunks_of_a_bucket_lose_no_link(spark):
    """Small buckets, large ones and buckets of several chunks find the same, for
    a group of near copies that is larger than a small bucket, too."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=24)
    rows = vectors() + [(2000 + i, [float(np.float32(c)) for c in base + 0.05 * rng.normal(size=24)], 1, "x") for i in range(120)]
    df = spark.createDataFrame(rows, VECTORS)
    found = lambda chunk: sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in capfilters.linked(df, chunk=chunk).collect())
    whole = found(1024)
    assert sum(n == 119 for i, n, _ in whole if len(i) == 4) == 120
    assert found(50) == whole and found(100) == whole


def test_rows_that_repeat_a_vec_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0, 0, 0], 2**40, "x"), (1, [0, 1.0, 0, 0], 2**40, "x"), (2, [1.0, 0.01, 0, 0], 2**40, "x"), (3, [0.01, 1.0, 0, 0], 2**40, "x"), (4, [0.0, -0.0, 0.0, 1.0], 2**40, "x"), (5, [0.0, 0.0, 0.0, 1.0], 2**40, "x")]
    df = spark.createDataFrame([(a, [float(x) for x in v], c, d) for a, v, c, d in rows], "vec_id long, embedding array<float>, label long, rep string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in capfilters.linked(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_pairs_just_above_the_bound_are_found(spark):
    """The worst case: links in 64 dimensions with cosines of 0.93 to 0.935."""
    rng = np.random.default_rng(8)
    n = 6000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(n, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.935, (n, 1))
    y = c * x + np.sqrt(1 - c * c) * z
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.vstack([x, y]).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in capfilters.linked(df).collect()}
    assert sum(got[i] >= 1 for i in range(n)) >= 0.998 * n


def test_top_k_equals_brute_force(spark):
    """Rows are queries and candidates each, also where they repeat an id."""
    from pyspark.sql import functions as F

    rows = vectors(1)
    rows += [rows[40], (40, rows[41][1], 1, "x"), (60, [2.0**38 + 1024.0, -3.0] + [0.0] * 22, 1, "x"), (3, [7.0] * 24, 1, "x"), (3, [7.0] * 24, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    ok = [(r[0], [math.floor(1024 * c) for c in r[1]] + [0] * (24 - len(r[1]))) for r in rows if r[0] is not None and usable(r[1])]
    want = collections.Counter()
    for a, (i, v) in enumerate(ok):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(ok) if b != a)[:10]
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    for group in (7, topk.GROUP):
        assert collections.Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 10, group=group, head=50).collect())) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 10).count() == 0


def test_quality_learns_and_scores_every_text(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["the", "plain", "words", "stand", "here"]) + rnd.choice(["", ",", "."]) for _ in range(rnd.randint(20, 200)))
    bad = lambda: " ".join(rnd.choice("ABCD") * 4 + "!!" for _ in range(rnd.randint(20, 200)))
    rows = [(i, good() if i % 3 else bad(), "x") for i in range(240)] + [(500, None, "x"), (501, "", "x"), (None, "text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_of(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(240))
    assert sum(got[i].predicted == int(i % 3 > 0) for i in held) >= 0.95 * len(held)
    assert {r.score for r in quality.quality_of(docs, labels.limit(0)).collect()} == {0.5}


def bags(seed=0):
    rng = np.random.default_rng(seed)
    many = np.array([3, 1, 5])
    size = np.array([4, 0, 2, 3, 1, 1, 7, 2, 5])
    return rng.normal(size=(9, quality.FEATURES)), many, rng.integers(0, quality.BUCKETS, size.sum()), size, np.array([1.0, 0.0, 1.0])


def test_quality_gradient():
    """The gradients of every layer are those of small steps; attention sums to 1."""
    x, many, words, size, y = bags()
    w = quality.fit(np.tile(x, (20, 1)), np.tile(many, 20), np.tile(words, 20), np.tile(size, 20), np.tile(y, 20))
    assert ((quality.score(w, x, many, words, size) >= 0.5) == y).all()
    assert np.allclose(np.add.reduceat(quality.forward(w, x, many, words, size)["att"], [0, 3, 4]), 1)
    rng = np.random.default_rng(1)
    w = {k: v + 0.1 * rng.normal(size=v.shape) if k not in ("mean", "scale", "use") else v for k, v in w.items()}
    w["c"], w["d"] = w["c"] * 0.1, w["d"] * 0.1
    loss = lambda w: -np.mean(y * np.log(p := quality.score(w, x, many, words, size)) + (1 - y) * np.log(1 - p))
    grad = quality.gradients(w, x, many, words, size, y)
    for name, g in grad.items():
        for _ in range(6):
            at = (int(rng.choice(words)), int(rng.integers(quality.WIDTH))) if name == "E" else tuple(int(rng.integers(n)) for n in g.shape)
            up, down = ({**w, name: w[name].copy()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert math.isclose((loss(up) - loss(down)) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-8), name


def test_quality_scores_equal_a_plain_forward_pass(docs):
    """One passage and one word at a time, without matrices."""
    import pyarrow as pa

    texts = [r.text for r in docs.collect()]
    x, many, words_, size = quality.passages(pa.array(texts))
    w = quality.fit(x, many, words_.astype(int), size, np.array([len(t or "") % 2 for t in texts], float))
    got = quality.score(w, x, many, words_, size)
    at = 0
    for t, n, s in zip(texts, many, got):
        all_words, reps, gates = words(t), [], []
        assert n == max(1, -(-len(all_words) // quality.PASSAGE))
        for k in range(n):
            own = all_words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
            hashes = hashed_words(pa.array([b" ".join(own).decode("utf-8", "replace")]))[0] if own else []
            mean = sum((w["E"][int(h) >> 51] for h in hashes), np.zeros(quality.WIDTH)) / max(len(own), 1)
            h = np.tanh(np.append((x[at] - w["mean"]) / w["scale"], mean) @ w["W"] + w["b"])
            reps.append(h)
            gates.append(float((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]))
            at += 1
        weight = np.exp(np.array(gates) - max(gates))
        z = (weight[:, None] * np.array(reps)).sum(0) / weight.sum()
        assert math.isclose(s, 1 / (1 + math.exp(-float(z @ w["c"] + w["d"][0]))), rel_tol=1e-9)


def test_quality_knows_words(spark):
    """Labels that only the words tell: the same lengths, classes and marks."""
    rnd = random.Random(6)
    good, bad = (["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(30)] for _ in range(2))
    rows = [(i, " ".join(rnd.choice(good if i % 2 or rnd.random() < 0.5 else bad) for _ in range(90)), "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, rows[0], (1, rows[0][1], "x")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    scores = lambda d, l: sorted((r.doc_id, r.held_out, round(r.score, 9)) for r in quality.quality_of(d, l).collect())
    got = scores(docs, labels)
    held = [(i, s) for i, h, s in got if h]
    assert sum((s >= 0.5) == (i % 2 == 1) for i, s in held) >= 0.9 * len(held)
    assert got == scores(docs.repartition(5), labels.union(labels))
    assert quality.quality_of(docs.limit(0), labels).count() == 0


def test_suffix_tree(docs, none):
    rows = docs.collect()
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    toks = [[*words(r.text), None] for r in rows]
    c = collections.Counter(t for x, h in zip(toks, held) if not h for t in x)
    n, v = sum(c.values()), len(c)
    got = suffixtree.scored(docs, min_context=5e-3, min_edge=5e-4).collect()
    want = sorted((str(r.doc_id), h, len(x), sum(c[t] > 0 for t in x), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in x), 6)) for r, h, x in zip(rows, held, toks))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert suffixtree.scored(none).count() == 0


def test_suffix_tree_states_sum_to_one(spark):
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice(["a b c", "a b d", "x y", "z"]) for _ in range(60))
    df = spark.createDataFrame([(i, text()) for i in range(60)], "doc_id long, text string")
    got = suffixtree.scored(df, min_context=1e-3, min_edge=1e-4).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)  # contexts tell the next word


def test_runs_have_one_hash_wherever_they_stand():
    rng = np.random.default_rng(2)
    words_ = rng.integers(0, 2**64, 5, dtype=np.uint64)
    size = np.array([7, 1, 12])
    picked = rng.integers(0, 5, 20)
    of = suffixtree.Runs(words_[picked], size)
    seen = {}
    for n in range(1, 8):
        for at in of.ends(n).tolist():
            key = tuple(picked[at + 1 - n : at + 1])
            assert seen.setdefault(int(of(np.array([at]), n)[0]), key) == key
    assert len(set(seen.values())) == len(seen)
    table = suffixtree.Table(words_, np.arange(5))
    assert (table.keys[table.find(words_)] == words_).all() and (table.find(words_ + np.uint64(1)) == -1).all()


def prose(rnd, vocab, n):
    return " ".join(rnd.choice(vocab) for _ in range(n))


def invented(seed, n=300):
    rnd = random.Random(seed)
    parts = ["ra", "lo", "ten", "mi", "sur", "ve", "kal", "do", "ning", "est", "or", "ti"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(2, 4))) for _ in range(n)]


def test_secrets(spark):
    key = hashlib.sha1(b"x").hexdigest()
    vocab, rnd = invented(1), random.Random(2)
    fill = prose(rnd, vocab, 4000)
    text = f'plain words here token = "{key}" and {vocab[0]}{vocab[1]}{vocab[2]}{vocab[3]} 4845168114407329 mail.50@mail6.example.com é {key[:10]}'
    rows = [(1, text, 5, 7), (2, None, 1, 1), (3, "", 0, 0), (4, "x" * 5000, 5000, 2), (None, text, 1, 1), (1, text, 5, 7), (5, f"password={key.upper()}", 3, 3), (6, fill, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, start long")
    got = secretscan.scanned(df).collect()
    hits = [r for r in got if r.is_secret]
    assert sorted(str(r.doc_id) for r in hits) == ["1", "1", "5", "None"]
    for r in hits:
        t = next(x[1] for x in rows if x[0] == r.doc_id)
        assert hashlib.sha256(t[r.start : r.start + r.length].encode()).hexdigest() == r.secret_sha256 and t[r.start : r.start + r.length].lower() == key
    out = secretscan.redacted(df).collect()
    assert sorted(str(r.text) for r in out) == sorted(str(x[1]).replace(key, "[SECRET]").replace(key.upper(), "[SECRET]") for x in rows)
    assert secretscan.scanned(df.limit(0)).count() == 0


def test_secrets_of_many_kinds_are_told_from_what_looks_alike(spark):
    """Precision and recall on planted keys and passwords that no training row
    holds: short ones, ones with signs and ones of a single case among them."""
    rnd = random.Random(21)
    vocab = invented(3)
    some = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    rows, planted, harmless = [], set(), set()
    for i in range(600):
        name = rnd.choice(["token", "password", "api_key", "secret", "client_secret"])
        secret, before, after = [
            (some(low + up + dig, rnd.randint(20, 40)), f'{name} = "', '"'), (some("0123456789abcdef", 40), f"{name}: ", " "), ("AKIA" + some(up + "234567", 16), f"{name}=", " "),
            ("AKIA" + some(up, 16), f"{name}=", " "), (some(low + up + dig + "!$#&*", rnd.randint(9, 15)) + "7", "password = ", " "), (some(low, 3) + "!" + some(up + dig, 9), 'pwd: "', '"'),
        ][i % 6]
        words_ = [rnd.choice(vocab) for _ in range(4)]
        other = [f"{''.join(words_)}", f"/usr/{'/'.join(words_)}/{some(dig, 3)}", f"https://www.{words_[0]}.com/{words_[1]}/{some(dig, 4)}.html", f"{words_[0]}.{words_[1]}@mail.{words_[2]}.org", some(dig, 16), f"{words_[0]}_{words_[1]}_{words_[2]}_{words_[3]}"][i % 6]
        rows.append((i, f"{prose(rnd, vocab, 40)} {before}{secret}{after} {prose(rnd, vocab, 20)} {other} {prose(rnd, vocab, 10)}"))
        planted.add((i, hashlib.sha256(secret.encode()).hexdigest()))
        harmless.add((i, hashlib.sha256(other.encode()).hexdigest()))
    got = secretscan.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found, flagged = {(r.doc_id, r.secret_sha256) for r in got}, {(r.doc_id, r.secret_sha256) for r in got if r.is_secret}
    assert planted <= found  # no gate before the forest
    assert len(planted & flagged) >= 0.95 * len(planted)
    assert len(flagged - planted) <= 0.03 * len(rows)


def test_places_of_many_candidates(spark):
    """Texts with more candidates than a block: each start is where the text has it."""
    rnd = random.Random(4)
    text = "é".join(f" {rnd.randrange(10**18, 10**19)}{'=' * (i % 3)}" for i in range(1500)) + ' secret="a!b!c!d!e!" end'
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted((r.start, r.text, r.before, r.after) for r in secretscan.candidates(df, "doc_id").collect())
    want = [(m.start(), m[0]) for m in re.finditer(r"\d{19}={0,2}", text)]
    assert [(a, b) for a, b, *_ in got[:-1]] == want and got[-1][1] == "a!b!c!d!e!" and got[-1][3] == '" end'
    assert all(text[: a].endswith(x) and text[a + len(t) :].startswith(y) and (len(x) > 20 or a < 48) for a, t, x, y in got)


def test_url_graph(spark):
    pages = [(1, "http://good.example.com/en/7", '<a href="http://b.org/x">'), (2, "http://b.org/x", "<a href='http://D.org/'>"), (3, "http://bad.com/en/x?q", None), (4, "http://spam.org/", '<a href="http://bad.com/">'), (5, None, None), (6, "no host", "x"), (7, "HTTP://d.ORG#f", ""), (8, "http://xcom/en/", None), (9, "http://a.example.net/de/81", None), (9, "http://a.example.net/de/81", None), (None, "http://q.org/es/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.judged(df).collect()}
    assert got == {
        1: ("good.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("b.org", "/x", None, "allow"), 3: ("bad.com", "/en/x", "com/en/", "block"), 4: ("spam.org", "/", None, "block"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("d.org", "", None, "allow"), 8: ("xcom", "/en/", None, "allow"), 9: ("a.example.net", "/de/81", "example.net/de/8", "block"), None: ("q.org", "/es/", "org/es/", "block")}
    assert urlgraph.judged(df.limit(0)).count() == 0


def test_url_query_follows_the_rules_of_its_contract(spark, tmp_path):
    urls = ["http://a.net/de/", "https://Example.NET/de/7", "x://b.example.net/de/81", "http://c.net/de", "http://com/en/", "http://example.com/en/70", "http://d.org/es/?q", None]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op8_url_filters(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "allow"),
        ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]


def test_suffix_tree_learns_by_count_at_every_length(spark, monkeypatch):
    """Runs that occur twice are learned however large the corpus is, contexts go
    beyond two words, and the tables score as a plain version does."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["p q r s1 t1", "u q r s2 t2", "z r s3", "v w", "p w"]) for _ in range(30)) for _ in range(30)]
    texts += [" ".join(f"f{rnd.randrange(3000)}" for _ in range(400)) for _ in range(30)] + ["once alpha beta gamma again"] * 3 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    toks = [[*words(t), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    train = [t for t, h in zip(toks, held) if not h]
    count = collections.Counter(tuple(t[i:j]) for t in train for i in range(len(t)) for j in range(i + 1, min(i + 14, len(t)) + 1))
    n, v = sum(map(len, train)), len({x for t in train for x in t})
    follow = collections.defaultdict(list)
    for g, m in count.items():
        if len(g) > 1 and m >= 2:
            follow[g[:-1]].append((g[-1], m))
    kept = [{}]

    def log_p(ctx, w, longest):
        back = 0.0
        for d in range(longest, 0, -1):
            state = kept[d].get(ctx[-d:]) if len(ctx) >= d else None
            if state:
                if w in state[0]:
                    return back + state[0][w]
                back += state[1]
        return back + math.log10((count[(w,)] + 0.5) / (n + 0.5 * (v + 1)))

    while len(kept) < 5:
        d, level = len(kept), {}
        for ctx, nexts in follow.items():
            if len(ctx) == d and count[ctx] >= 2 and (d == 1 or count[ctx[1:]] > max((m for _, m in follow[ctx[1:]]), default=0)):
                p = {w: (m - 0.5) / count[ctx] for w, m in nexts}
                q = {w: 10 ** log_p(ctx, w, d - 1) for w in p}
                rest, below = max(1 - sum(p.values()), 1e-12), max(1 - sum(q.values()), 1e-12)
                if count[ctx] * (sum(p[w] * math.log(p[w] / q[w]) for w in p) + rest * math.log(rest / below)) > 0.5 * (len(p) + 1) * math.log(count[ctx]):
                    level[ctx] = ({w: math.log10(x) for w, x in p.items()}, math.log10(rest / below))
        if not level:
            break
        kept.append(level)
    assert len(kept) == 5 and (b"alpha",) in kept[1]
    want = {i: sum(log_p(tuple(t[max(0, j - 14) : j]), w, len(kept) - 1) for j, w in enumerate(t)) for i, t in enumerate(toks)}
    every = sorted({x for t in train for x in t}, key=str)
    for ctx in [c for level in kept[1:] for c in list(level)[:4]]:  # with the one share of unseen words, next-word probabilities sum to 1
        unseen = math.log10(0.5 / (n + 0.5 * (v + 1))) + sum(kept[d][ctx[-d:]][1] for d in range(1, len(ctx) + 1) if ctx[-d:] in kept[d])
        assert math.isclose(sum(10 ** log_p(ctx, w, len(ctx)) for w in every) + 10**unseen, 1, rel_tol=1e-9)
    for head in (1 << 20, 20):
        monkeypatch.setattr(suffixtree, "HEAD", head)
        got = {r.doc_id: r.score for r in suffixtree.scored(df, depth=4, min_context=2, least_gain=0).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_url_walks_end_when_they_have_converged(spark):
    """Hosts far from a seed are reached, //host links count, and ranks are those
    of many rounds."""
    pages = [(i, f"http://h{i}.org/", f'<a href="//h{i + 1}.org/x">') for i in range(12)]
    pages += [(12, "https://h12.org/", '<a href="//bad.com/">'), (13, "http://bad.com/en/x", None), (14, "http://example.com/en/7", '<a href="http://h11.org/">')]
    got = {r.host: r for r in urlgraph.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    to = {f"h{i}.org": f"h{i + 1}.org" for i in range(12)} | {"h12.org": "bad.com", "example.com": "h11.org"}
    back = {}
    for a, b in to.items():
        back.setdefault(b, []).append(a)
    for kind, seed, steps in (("trust", "example.com", {a: [b] for a, b in to.items()}), ("distrust", "bad.com", back)):
        rank = {seed: 1.0}
        for _ in range(400):
            new = {seed: 0.15}
            for a, x in rank.items():
                for b in steps.get(a, [a]):
                    new[b] = new.get(b, 0) + 0.85 * x / len(steps.get(a, [a]))
            rank = new
        assert all(abs(getattr(r, kind) - rank.get(h, 0)) < 1e-5 for h, r in got.items())
    assert got["h0.org"].distrust > 0 and got["h0.org"].verdict == "block"


def test_url_ranks_equal_brute_force(spark):
    """A random graph with a hub, long html, many links to one host, links back
    to the page's own host, and hosts whose trust and distrust tie."""
    rnd = random.Random(9)
    hosts = ["a.example.com", "b.com", "c.net", "d.org", *[f"h{i}.io" for i in range(40)]]
    path = {"a.example.com": "/en/7", "b.com": "/en/", "c.net": "/de/1", "d.org": "/es/"}
    pages, links = [], collections.Counter()
    for i in range(150):
        host = rnd.choice(hosts) if i >= len(hosts) else hosts[i]
        to = [rnd.choice(hosts) for _ in range(rnd.randint(0, 5))] + (hosts[4:] * 3 if i == 20 else [])
        pages.append((i, f"http://{host}{path.get(host, '/x')}", "x" * (3_000_000 if i == 5 else 10) + " ".join(f'<a HREF="http://{t.upper()}/p?q">' for t in to)))
        links.update((host, t) for t in to if t != host)
    pages += [(200, "http://tie.io/", '<a href="//alone.com/">'), (201, "http://alone.com/en/", None), (202, "http://z.example.com/en/7", '<a href="http://tie.io/">')]
    links.update({("tie.io", "alone.com"): 1, ("z.example.com", "tie.io"): 1})
    got = {}
    for r in urlgraph.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        got[r.host] = (r.trust, r.distrust)
        assert r.verdict == ((("block" if r.distrust > r.trust else "allow")) if r.rule is None else r.verdict) and r.by_graph == (r.rule is None)
    every = sorted({h for _, u, _ in pages for h in [u.split("/")[2]]})
    seed = {"trust": [h for h in every if h.endswith("example.com")], "distrust": [h for h in every if h in ("b.com", "c.net", "d.org", "alone.com")]}
    for k, (kind, edges) in enumerate({"trust": links, "distrust": {(b, a): n for (a, b), n in links.items()}}.items()):
        out = collections.Counter()
        for (a, _), n in edges.items():
            out[a] += n
        rank = {h: 1 / len(seed[kind]) for h in seed[kind]}
        start = dict(rank)
        for _ in range(300):
            new = {h: 0.15 * x for h, x in start.items()}
            for h, x in rank.items():
                if not out[h]:
                    new[h] = new.get(h, 0) + 0.85 * x
            for (a, b), n in edges.items():
                if a in rank:
                    new[b] = new.get(b, 0) + 0.85 * rank[a] * n / out[a]
            rank = new
        assert all(abs(got[h][k] - rank.get(h, 0)) < 1e-4 for h in every)
