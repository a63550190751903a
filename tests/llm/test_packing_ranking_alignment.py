"""Packing, ranked search and tokenizer alignment against plain versions, whole tables and small odd ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrain.llm import alignment, packing, ranked
from tidegrain.llm.batches import table
from tidegrain.llm.bpe import byte_of

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "word", "a b c d e", "Straße 東京 😀 naïve\r\nnext\n\nline", "same words here\n" * 40, "un deux trois " * 900, "<|endoftext|> and <|startoftext|> <s>", "a▁b c", "x" * 5000, "İΣ ς'll don't 's"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*enumerate(ODD), (3, "word"), (None, "null id text word")]
    clash = {"length": F.lit("clash"), "slots": F.lit(1), "block": F.lit("x"), "score": F.lit(2), "id": F.lit("y")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


# Packing


@pytest.fixture(scope="module")
def word_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def pieces_by_hand(tool, docs, longest=4096):
    out = []
    for i, text in docs:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        while at < len(ids):
            size = min(longest, 1 << ((len(ids) - at).bit_length() - 1))
            out.append((i, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids)))
            at += size
    return out


def check_buckets(rows):
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    places = defaultdict(list)
    for r in rows:
        assert r.length == 1 << (r.sequence_id >> 48)
        places[r.length].append(r.sequence_id & ((1 << 48) - 1))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_packing_whole_result(spark, word_tokenizer):
    rows = packing.op11_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted(pieces_by_hand(word_tokenizer, docs))
    check_buckets(rows)


def test_packing_odd_rows(spark, odd, word_tokenizer):
    docs = [*enumerate(ODD), (3, "word"), (None, "null id text word")]
    cuts = packing.pieces(odd, longest=64)
    rows = packing.bucketed(cuts, bin_pieces=7).collect()
    assert by_key((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == by_key(pieces_by_hand(word_tokenizer, docs, 64))
    check_buckets(rows)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    again = packing.bucketed(cuts.repartition(3), bin_pieces=7).collect()
    assert by_key(tuple(r)[:5] + (r.sequence_id,) for r in again) == by_key(tuple(r)[:5] + (r.sequence_id,) for r in rows)
    assert packing.bucketed(packing.pieces(odd.limit(0))).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(odd, longest=100)


def test_packing_many_equal_rows(spark):
    rows = packing.bucketed(packing.pieces(spark.createDataFrame([(1, "same words")] * 200, "doc_id long, text string"), with_ids=False), bin_pieces=16).collect()
    assert len(rows) == 200 * len({r.start for r in rows})
    check_buckets(rows)


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ranked_by_hand(docs, items, k=10):
    lists = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    lists = [(i, Counter(w), len(w)) for i, w in lists if w]
    n_docs, n_terms = len(lists), sum(n for _, _, n in lists)
    df = Counter(t for _, c, _ in lists for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c, n in lists:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_ranked_whole_result(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert sorted(map(tuple, ranked.op12_ranked(spark, SF).collect())) == sorted(ranked_by_hand(docs, items))


def test_ranked_odd_rows(spark, odd):
    docs = [*enumerate(ODD), (3, "word"), (None, "null id text word")]
    texts = [(1, "word WORD x東京"), (2, None), (3, "..."), (4, "un trois quatre word"), (None, "b c d"), (5, "same words here"), (4, "un trois quatre word")]
    items = spark.createDataFrame(texts, "item_id long, text string").withColumns({"terms": F.lit(1), "score": F.lit(2)})
    want = by_key(ranked_by_hand(docs, texts[:-1], 3))
    assert by_key(map(tuple, ranked.search(odd, items, k=3).collect())) == want
    assert by_key(map(tuple, ranked.search(odd.repartition(5), items, k=3, block_items=2).collect())) == want
    assert ranked.search(odd.limit(0), items).count() == 0 and ranked.search(odd, items.limit(0)).count() == 0


def test_masks_against_scores_of_all_documents():
    """Blocks after one another: what is dropped by its bound is never one of the best, ties included."""
    r = random.Random(3)
    for case in range(40):
        terms, n = r.randint(1, 12), r.randint(1, 300)
        rows = [{t: r.randint(1, 3) for t in range(terms) if r.random() < 1 / (1 + t)} for _ in range(n)]
        lengths = np.array([max(1, sum(x.values())) + r.randint(0, 2) for x in rows])
        slots = np.array(r.sample(range(terms), r.randint(1, terms)))
        weights = np.array([r.randint(0, 50) for _ in slots])
        every = sum(lengths.tolist())
        best = []
        for at in range(0, n, 90):
            part = rows[at : at + 90]
            as_list = lambda f: pa.array([f(x) for x in part], pa.list_(pa.int32()))  # noqa: B023, E731
            block = ranked.Block(list(range(at, at + len(part))), lengths[at : at + 90], as_list(lambda x: sorted(x)), as_list(lambda x: [x[t] for t in sorted(x)]), terms, n, every)
            best = ranked.best_of_block(block, slots, weights, best, 5)
        score = lambda d: sum(int(w) * ((10**9 * rows[d][t]) // (1000 * rows[d][t] + 8 * (25 + 75 * int(lengths[d]) * n // every))) for t, w in zip(slots.tolist(), weights) if t in rows[d])  # noqa: B023, E731
        assert best == sorted((-score(d), d) for d in range(n) if score(d) > 0)[:5], case


# Alignment


def aligned_by_hand(docs):
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, back = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte_of()
    a.encode_special_tokens = True
    of_a = lambda i: bytes(back[ord(c)] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, held = [], Counter()
    for ident, text in docs:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx, by = [of_a(i) for i in x], [of_b(i) for i in y]
        if not text or not b"".join(bx) == b"".join(by) == (" " + text).encode():
            x, y, bx, by = [], [], [], []
        ex, ey = np.cumsum([len(t) for t in bx]).tolist(), np.cumsum([len(t) for t in by]).tolist()
        links, i, j = Counter(), 0, 0
        while i < len(x):
            links[x[i], y[j]] += 1
            e = min(ex[i], ey[j])
            i, j = i + (ex[i] == e), j + (ey[j] == e)
        both = sorted(set(ex) & set(ey))
        side = lambda ids, ends: [",".join(str(t) for t, e in zip(ids, ends) if lo < e <= hi) for lo, hi in zip([0, *both], both)]
        text_ = ";".join("|".join(p) for p in zip(side(x, ex), side(y, ey)))
        held.update(links.keys())
        rows.append((ident, len(x), len(y), len(both), links, text_))
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    return [
        (i, x, y, g, sum(links.values()), sum(n for k, n in links.items() if held[k] == top[k[0]]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(t.encode()).hexdigest() if t else "")
        for i, x, y, g, links, t in rows
    ]


def test_alignment_whole_result(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").limit(60).collect()]
    part = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.link_counts(part).collect())) == sorted(aligned_by_hand(docs))


def test_alignment_odd_rows(spark, odd):
    r = random.Random(5)
    marks = [" ", "  ", "\n", "\t", "the", " the", "'s", "1", "é", "​", " ", "　", " ", "東", "😀", "!", "\x1f", "\x7f", "́", "<0x0A>", "<s>", "▁", "\x85"]
    mixed = [(100 + i, "".join(r.choice(marks) for _ in range(r.randint(1, 30)))) for i in range(300)]
    docs = [*enumerate(ODD), (3, "word"), (None, "null id text word"), *mixed]
    frame = odd.unionByName(spark.createDataFrame(mixed, "doc_id long, text string"), allowMissingColumns=True)
    want = by_key(aligned_by_hand(docs))
    assert by_key(map(tuple, alignment.link_counts(frame).collect())) == want
    assert alignment.link_counts(odd.limit(0)).count() == 0
    groups = {x.doc_id: x for x in alignment.align(odd).where("doc_id is not null").collect()}
    assert groups[1].a_ids == [] and groups[9].b_sizes == []
    for x in groups.values():
        assert sum(x.a_sizes) == len(x.a_ids) and sum(x.b_sizes) == len(x.b_ids) and len(x.a_sizes) == len(x.b_sizes)


def test_alignment_links_from_groups(spark):
    """Within a group the links are the tokens of both sides less one."""
    docs = table(spark, SF, "documents")
    sums = {r.doc_id: sum(p + q - 1 for p, q in zip(r.a_sizes, r.b_sizes)) for r in alignment.align(docs).collect()}
    assert {r.doc_id: r.n_links for r in alignment.op13_alignment(spark, SF).collect()} == sums


def test_a_pool_starts_anew(monkeypatch):
    from tidegrain.llm import pools

    monkeypatch.setattr(pools, "MOST_STRINGS", 3)
    pool = pools.Pool(lambda words: pools.flattened([[len(w)] * len(w) for w in words]), check=lambda words, ids, widths: widths == [len(w) for w in words])
    for words in (["a", "bb", "ccc", "dddd"], ["bb", "e"], ["", "ffff"]):
        ids, widths = pool.gather(pool.look_up(words))
        assert widths.tolist() == [len(w) for w in words] and ids.tolist() == [len(w) for w in words for _ in w] and pool.good.all()


