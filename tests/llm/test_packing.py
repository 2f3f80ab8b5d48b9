import collections
import zlib

import numpy as np

from granary.llm import packing


def plain_ids(texts):
    """Of the tokenizer as it is in its file."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(packing.default_tokenizer())
    return [made.encode(t, add_special_tokens=False).ids for t in texts]


def ids_of(texts, encode=None):
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    ids, n = (encode or packing.PreTokens(packing.default_tokenizer()))(np.frombuffer(b"".join(raw), np.uint8), off)
    at = np.append(0, np.cumsum(n))
    return [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)]


def test_ids_equal_whole_text():
    texts = ["Hello, world's  best\n\nthing\t<|endoftext|> x", "", "Ünïcode é́ ΑΣ ΌΣΟΣ nb  em ​ zero", "ab" * 300, "don't we'll 12345 #$%&", "日本 語 テキスト 🙂🙂 x", "  "]
    texts += ["<|startoftext|><|endoftext|", "'s 'tis x'llama ''re --'d a'É ×÷ ßÿÀ", "'", "s it"]
    assert ids_of(texts) == plain_ids(texts)


def test_ids_of_random_texts(monkeypatch):
    rng = np.random.default_rng(6)
    signs = [*"abzABZstmdrevl0129.,!?-_<|> \n\t\x1f\x85'''ÀÉßÿ×÷éü–日İſ", "'s", "'re", "'ll", "<|endoftext|>", "é"]
    plain = [x for x in signs if x.isascii() and x != "\x1f"]
    texts = ["".join(rng.choice(signs if rng.random() < 0.3 else plain, rng.integers(0, 40))) for _ in range(3000)]
    monkeypatch.setattr(packing, "POOL", 2000)  # the table is emptied now and then
    encode = packing.PreTokens(packing.default_tokenizer())
    got = [x for i in range(0, len(texts), 100) for x in ids_of(texts[i : i + 100], encode)]
    assert got == plain_ids(texts)


def test_table_with_few_places(monkeypatch):
    """Pre-tokens that meet in a place push each other out and are asked for again."""
    real = packing.C.hashed

    def hashed(*given):
        h, head = real(*given)
        return h & np.uint64((1 << 46) - 1), head

    monkeypatch.setattr(packing.C, "hashed", hashed)
    texts = [f"alpha beta{i} gamma {i * 37} delta" for i in range(200)] * 2
    assert ids_of(texts) == plain_ids(texts)


def test_fill():
    assert packing.fill([700, 500, 300], {700: 1, 500: 1, 300: 3}, 1300) == {700: 1, 300: 2}
    assert sum(n * k for n, k in packing.fill([9, 6], {9: 1, 6: 5}, 20).items()) == 18
    assert packing.fill([9], {9: 4}, 5) == {}
    counts = {n: (n * 7919) % 13 + 1 for n in range(1, 129)}
    used = collections.Counter()
    for times, multiset in packing.plan(counts, 128):
        assert sum(n * k for n, k in multiset.items()) <= 128
        for n, k in multiset.items():
            used[n] += times * k
    assert used == counts


def test_slack_is_least():
    """Each window's multiset leaves no more slack than any other of the lengths left."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        counts = dict(collections.Counter(rng.integers(1, 25, 9).tolist()))
        left = collections.Counter(counts)
        for times, used in packing.plan(counts, 24):
            first, sums = max(n for n in left if left[n]), {0}
            for n in (left - collections.Counter([first])).elements():
                sums |= {x + n for x in sums if x + n <= 24 - first}
            assert first in used and sum(n * k for n, k in used.items()) == first + max(sums)
            for n, k in used.items():
                left[n] -= times * k
        assert not +left


def test_packing(docs, corpus, nothing):
    path = packing.default_tokenizer()
    rows = packing.pack(docs, path, 64, with_ids=True).collect()
    whole = collections.Counter((r[0], (*ids, 1)) for r, ids in zip(corpus, plain_ids([r[1] or "" for r in corpus]), strict=True))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id, r.start].append((r.doc_tokens, tuple(ids.tolist())))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter()
    for (d, ids), n in whole.items():
        for at in range(0, len(ids), 64):
            want[d, at, len(ids), ids[at : at + 64]] += n
    assert collections.Counter((d, at, *p) for (d, at), ps in pieces.items() for p in ps) == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(nothing, path).collect() == []


def test_op4_packing(spark, tmp_path):
    """The query, at its own window, against ids of the tokenizer as it is."""
    rng = np.random.default_rng(8)
    words = ["word", "Other", "it's", "12", "<|endoftext|>", "naïve", "日本"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 700, 3000, 5000, 2047, 40)] + [None, ""] + [" ".join(["word"] * n) for n in (2047, 2048, 1023)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = {d: [*x, 1] for d, x in enumerate(plain_ids([t or "" for t in texts]))}
    rows = packing.op4_packing(spark, str(tmp_path)).collect()
    found, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        found[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, ids in whole.items():
        assert [at for at, _ in sorted(found[d])] == list(range(0, len(ids), 2048)) and sum(n for _, n in found[d]) == len(ids)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    short = sum(len(ids) % 2048 for ids in whole.values())
    assert len(sequences) <= sum(len(ids) // 2048 for ids in whole.values()) + -(-short // 2048) + 1
