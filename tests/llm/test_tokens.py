"""Token ids, Huffman files and packing against the library and each other."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from hypothesis import given, settings, strategies as st  # noqa: E402

from defectlens.llm import op10_packing as packing  # noqa: E402
from defectlens.llm import op2_huffman as huffman  # noqa: E402
from defectlens.llm.tokens import PieceEncoder  # noqa: E402

VOCABULARIES = [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "blank")]
ODD = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\nx y", "a\0b c", "\x01 \x02", "x \t y", "it's 'so' 's", "<|endoftext|> hi",
       "e \u0301 x", "ABC d\u00e9f\n\n\n ghi", "\u6570 \u5b57 12", "a\r\n b \x1c c", "   q", "a\u3000b", "word\nNext. (and) ***!!"]


def ids_by_library(name, texts):
    return PieceEncoder(P.path(name), "space")._library_ids(texts)


@pytest.mark.parametrize("name,cut", VOCABULARIES)
def test_odd_texts(name, cut):
    texts = ODD + [" ".join(ODD)] * 2
    ids, at = PieceEncoder(P.path(name), cut).encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == ids_by_library(name, texts)


@pytest.mark.parametrize("name,cut", VOCABULARIES)
def test_random_texts_and_thinned_memo(name, cut, monkeypatch):
    monkeypatch.setattr("defectlens.llm.tokens.MEMO_PIECES", 20)
    enc = PieceEncoder(P.path(name), cut)

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(st.sampled_from("abXYé'’.,!?- 0\n\t 　数<|>*ſ\u0301"), max_size=40), max_size=5))
    def check(texts):
        ids, at = enc.encode(texts)
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == ids_by_library(name, texts)

    check()


@pytest.mark.parametrize("name,cut", VOCABULARIES)
def test_each_word_is_merged_once(name, cut, monkeypatch):
    """Words stay known when the pieces around them are thinned, and their own memo is bounded too."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(200)]
    monkeypatch.setattr("defectlens.llm.tokens.MEMO_PIECES", 20)
    batches = [[" ".join(w + mark for w in words)] for mark in (",", "!", "?")]

    def merged():
        enc, sent = PieceEncoder(P.path(name), cut), []
        plain = enc._word_ids
        monkeypatch.setattr(enc, "_word_ids", lambda new: sent.extend(new) or plain(new))
        for texts in batches:
            ids, at = enc.encode(texts)
            assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == ids_by_library(name, texts)
        return sent

    sent = merged()
    assert len(sent) == len(set(sent))
    monkeypatch.setattr("defectlens.llm.tokens.MEMO_WORDS", 20)
    assert len(merged()) > len(sent)


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(0, 1000, 300), 2 ** np.arange(40)])
    lengths = huffman.code_lengths(counts, 12)
    used = lengths[counts > 0].astype(float)
    assert used.max() <= 12 and (lengths[counts == 0] == 0).all() and (2.0 ** -used).sum() <= 1
    import heapq
    small = [5, 9, 12, 13, 16, 45, 1, 1]
    heap = [(c, i) for i, c in enumerate(small)]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], 99))
    assert int((huffman.code_lengths(np.array(small)) * np.array(small)).sum()) == cost
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1] and not huffman.code_lengths(np.zeros(3, int)).any()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_bits_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 3000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3000))
    bits, at = huffman.pack_bits(ids, lengths, huffman.canonical_codes(lengths))
    assert huffman.unpack_bits(bits, at, n, huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_bits_in_sections(monkeypatch):
    """Sections of few checkpoints give the same ids, at places beyond 32 bits of their own too."""
    ids = (np.random.default_rng(9).zipf(1.3, 3001) % 3000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3000))
    bits, at = huffman.pack_bits(ids, lengths, huffman.canonical_codes(lengths))
    assert at.dtype == np.uint64
    for section in (1, 2, 7):
        monkeypatch.setattr(huffman, "SECTION", section)
        assert huffman.unpack_bits(bits, at, len(ids), huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_huffman_folder_alone(spark, make_docs, tmp_path):
    """A new process with a new session reads the folder, with nothing from the writer but its path."""
    texts = ODD + ["the same text of some words"] * 3
    folder = str(tmp_path / "ids")
    huffman.write_huffman(make_docs(list(enumerate(texts))), P.path("byte_bpe_50k.json"), folder)
    code = ("import sys, numpy as np\n"
            "from defectlens.session import build_session\n"
            "from defectlens.llm.op2_huffman import decode_blocks\n"
            "for r in decode_blocks(build_session(), sys.argv[1]).collect():\n"
            "    print('row', r['doc_id'], np.frombuffer(r['ids'], '<u4').tolist())\n")
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code, folder], cwd=root, capture_output=True, text=True, timeout=300, check=True).stdout
    got = sorted(line for line in out.splitlines() if line.startswith("row "))
    want = ids_by_library("byte_bpe_50k.json", texts)
    assert got == sorted(f"row {k} {[*map(int, x), 2]}" for k, x in enumerate(want))
    huffman.write_huffman(make_docs([]), P.path("byte_bpe_50k.json"), folder + "-empty")
    assert huffman.decode_blocks(spark, folder + "-empty").count() == 0


def test_huffman_files(spark, make_docs, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 50)
    texts = ODD + ["the same text of some words"] * 9 + ["long " * 3000]
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(None, None), (3, "x"), (3, "x")]
    got = huffman.huffman_report(make_docs(rows), P.path("byte_bpe_50k.json")).collect()
    want = ids_by_library("byte_bpe_50k.json", [t or "" for _, t in rows])
    crc = lambda x: zlib.crc32(np.array(x + [2], "<u4").tobytes())
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (i or -1, len(x) + 1, crc(x)) for (i, _), x in zip(rows, want))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in got] == sorted(i or -1 for i, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert huffman.huffman_report(make_docs([]), P.path("byte_bpe_50k.json")).count() == 0


def test_pack_histogram_uses_every_piece_once():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(n) for k, n in zip(range(1, 101), rng.integers(0, 50, 100)) if n}
    patterns = packing.pack_histogram(histogram, 100)
    used: dict[int, int] = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 100 and count > 0
        for k in pattern:
            used[k] = used.get(k, 0) + count
    assert used == histogram
    tokens = sum(k * n for k, n in histogram.items())
    assert sum(c for _, c in patterns) <= 1.02 * tokens / 100 + 1


def test_packing(spark, make_docs):
    rows = [(k % 40, f"word{k} " * (k * 7 % 90)) for k in range(120)] + [(None, None), (1, ""), (7, "long " * 500)]
    packed = packing.pack(make_docs(rows), P.path("word_bpe_49k.json"), size=64, keep_ids=True)
    got = packed.collect()
    want = sorted(tuple(x + [2]) for x in ids_by_library("word_bpe_49k.json", [t or "" for _, t in rows]))
    docs: dict = {}
    for r in got:
        assert r["length"] <= 64 and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert sum(r["length"] for r in got) == sum(map(len, want))
    by_sequence: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= 64
    pieces = sorted(tuple(np.frombuffer(r["ids"], "<u4").tolist()) for r in got)
    assert pieces == sorted(x[a:a + 64] for x in want for a in range(0, len(x), 64))
    joined = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed).collect()}
    assert joined == by_sequence
    assert packing.packing_report(make_docs([]), P.path("word_bpe_49k.json")).count() == 0
    del docs
