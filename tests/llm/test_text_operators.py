import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from lodestore.llm import packing, quality, sentencepiece_codec, simhash

from .cases import documents

public_tokenizers = pytest.importorskip("public_tokenizers")
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_quality_counts(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (13, 1), (14, 0), (None, 1), (0, 1)], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels)

    def want(text):
        text = text or ""
        words = ASCII_WORD.findall(text)
        lines = [x for x in text.split("\n") if ASCII_WORD.search(x)]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        n = len(words)
        failed = n < 10 or 100 * len(marked) > 20 * n
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert pairs(got, "doc_id", *names) == sorted(((r.doc_id, *want(r.text)) for r in docs.collect()), key=repr)
    assert all(not (r.base_failed and r.kept) for r in got.collect())
    assert pairs(got, "doc_id", "llr", "kept") == pairs(quality.quality_rules(docs.repartition(5), labels), "doc_id", "llr", "kept")
    assert all(r.llr == 0 and r.kept != r.base_failed for r in quality.quality_rules(docs).collect())
    assert quality.quality_rules(documents(spark, empty=True), labels).count() == 0


def test_llr_is_the_ratio_of_two_multinomials(spark):
    docs = spark.createDataFrame([(1, "good words here " * 4), (2, "bad junk stuff " * 4)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    counts = quality.ngram_counts(docs, labels.select("doc_id")).collect()
    raw, trusted = sum(r.n_raw for r in counts), sum(r.n_target for r in counts)
    assert (raw, trusted) == (46, 23)
    size = 1 << quality.BITS
    by = {r.bucket: np.log((r.n_target + 1) / (trusted + size)) - np.log((r.n_raw + 1) / (raw + size)) for r in counts}
    words = ("good words here " * 4).encode().split()
    own = [by[int(b)] for b in quality._buckets(*quality._word_ids(words), quality.BITS)]
    got = {r.doc_id: r.llr for r in quality.quality_rules(docs, labels).collect()}
    assert got[1] == pytest.approx(np.mean(own)) and got[1] > 0 > got[2]


def test_repeat_words_of_many_kinds():
    words = [str(i).encode() for i in range(9000)] + [b"1", b"2", b"3", b"4", b"5"]
    kinds, ids = None, None
    kinds, ids = quality._word_ids(words)
    assert quality._repeat_words(ids, len(kinds)) == 10


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    total = 0
    for r in docs.collect():
        want = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        total += len(want)
        parts = [want[i : i + 4096] for i in range(0, len(want), 4096)]
        have = [(x.piece, x.start, list(x.ids)) for x in pieces[r.doc_id]]
        assert all((k, 4096 * k, p) in have for k, p in enumerate(parts))
    assert sum(r.length for r in rows) == total
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.pack_documents(documents(spark, empty=True), path).count() == 0


def test_packing_over_a_tree_of_rounds(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('word ', cast(id * 7 % 1500 as int)) as text").repartition(40, "doc_id")
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert got.count() == 400
    assert got.select("sequence_id").distinct().count() <= 1.05 * got.agg({"length": "sum"}).first()[0] / 4096 + 1


def test_best_fit_takes_the_tightest_bin():
    assert best_sizes([5, 3, 4, 2, 6], 10) == [[6, 4], [5, 3, 2]]


def best_sizes(lengths, capacity):
    return [[lengths[i] for i in b] for b in packing.best_fit(lengths, capacity)]


def test_simhash_against_brute_force(spark):
    import xxhash

    docs = documents(spark)

    def print_of(text):
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in ASCII_WORD.findall(text or "")]
        if not words:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = [(r.doc_id, print_of(r.text)) for r in docs.collect()]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(rows)), key=repr)
    assert pairs(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_groups(documents(spark, empty=True)).count() == 0
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*least.values(), None}


def test_linked_pairs_find_every_pair_within_three_bits(spark):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 2**63, 8)]
    fps = sorted({b ^ sum(1 << int(k) for k in r.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5) for _ in range(6)})
    want = {(a, b) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= 3}
    for segments in (2, 4):
        got = simhash.linked_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), segments=segments).collect()
        assert {(x.a, x.b) for x in got} == want and len(got) == len(want)


def test_codec_equals_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = documents(spark)
    got = sentencepiece_codec.sentencepiece_codec(docs, path)

    def want(text):
        ids = library.encode(text or "")
        said = library.decode(ids)
        return len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(said.encode()).hexdigest(), ids, said

    assert pairs(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded") == sorted(((r.doc_id, *want(r.text)) for r in docs.collect()), key=repr)
    assert sentencepiece_codec.sentencepiece_codec(documents(spark, empty=True), path).count() == 0


def test_codec_on_odd_texts():
    codec = sentencepiece_codec.PieceCodec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    odd = ["", " ", "  a  b ", "\n", "a\nb\n\n c", "▁x▁▁", "<s> </s> <unk> <0x0A>", "\x00\x01", "U.S.A...?!²", "👩‍👩‍👧​ x", "((a))[b] {c}", "..,,!!", "x" * 3000, "\t\t é½Ⅳ"]
    for text in odd:
        ids = codec.library.encode(text)
        assert codec.encode(text) == ids and codec.encode(text, verify=True) == ids
        assert codec.decode(ids) == codec.library.decode(ids)
    for ids in ([0, 5, 1], [131, 132, 400], [230, 160, 5, 300], [29000, 13, 28705]):
        assert codec.decode(ids) == codec.library.decode(ids), ids
