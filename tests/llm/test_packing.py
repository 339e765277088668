import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import packing as P
from lodestone.llm.queries import QUERIES
from tests.llm.cases import awkward, empty


def _padding(sequences):
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in sequences.values())


def _check(rows, ids_of):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = np.array(ids_of[doc][at : at + r["length"]], dtype="<u4")
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids_of[doc]) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids_of[doc])
    sizes = {}
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        sizes[s] = at
    return sizes


def test_query_is_an_exact_round_trip(spark, sf_dir):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs}
    sizes = _check(QUERIES["op3_packing"](spark, sf_dir).collect(), ids)
    assert _padding(sizes) == 0


def test_best_fill_is_optimal():
    draw = random.Random(3)
    for _ in range(300):
        counts = {draw.randint(1, 40): draw.randint(1, 4) for _ in range(draw.randint(1, 6))}
        room = draw.randint(0, 90)
        reach = {0}
        for length, n in counts.items():
            reach = {s + k * length for s in reach for k in range(n + 1)}
        used = P.best_fill(counts, room)
        assert all(0 < n <= counts[length] for length, n in used.items())
        assert sum(length * n for length, n in used.items()) == max(s for s in reach if s <= room)


def test_packer_uses_every_id_once():
    draw = random.Random(4)
    packer = P.Packer(3, capacity=64, buffer=32)
    ids = {d: np.arange(draw.choice([1, 5, 63, 64, 65, 200, draw.randint(1, 300)]), dtype="<u4") for d in range(500)}
    for d, x in ids.items():
        packer.add(d, x)
    packer.close()
    seen = {d: np.zeros(len(x), dtype=int) for d, x in ids.items()}
    sizes = {}
    for doc, start, length, _, total, sequence, offset, part in packer.rows:
        seen[doc][start : start + length] += 1
        assert len(ids[doc]) == total and (part == ids[doc][start : start + length]).all()
        sizes[sequence] = max(sizes.get(sequence, 0), offset + length)
    assert all((x == 1).all() for x in seen.values())
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes.values())
    assert sum(n < 64 for n in sizes.values()) <= 6  # what is less than one window at the end


def test_bin_slack_places_the_remainders():
    """A window takes at most one piece that is cut from a longer remainder, and few windows need one."""
    draw = random.Random(9)
    packer = P.Packer(0, capacity=1024, buffer=512)
    for d in range(6000):
        packer.add(d, np.zeros(draw.randint(1, 1023), dtype="<u4"))
    packer.close()
    cut, windows = {}, {}
    for _, start, length, _, total, sequence, _, _ in packer.rows:
        windows[sequence] = windows.get(sequence, 0) + length
        if start + length < total:
            cut[sequence] = cut.get(sequence, 0) + 1
    full = [s for s, n in windows.items() if n == 1024]
    assert len(windows) - len(full) <= 10 and max(cut.get(s, 0) for s in full) <= 1
    assert sum(cut.values()) <= 0.75 * len(full)


def test_ids_are_those_of_the_tokenizers_file_on_odd_texts(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(12)
    parts = ["a", "Z", "é", "ß", "ſ", "İ", "中文", "🎉", "\u200d", "e\u0301", " ", "  ", "\t", "\n", "\r\n", "\xa0", "\u3000", "'s", "'LL", "’re", "12", "٣", "Ⅷ", "½", "_", "--", "...", "\x00", "\x7f", "\ufeff", "ปี", "का", "<|endoftext|>", "<|end"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 60))) for _ in range(1500)] + ["a" * 20000, " " * 5000, "\n" * 5000, "ab " * 5000]
    rows = P.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).extend(r["ids"])
    assert found == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}


def test_awkward_documents(spark):
    rows = P.pack_documents(awkward(spark)).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3)) == 2
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert sum(r["start"] == 0 for r in rows) == awkward(spark).count()
    assert P.pack_documents(empty(spark)).count() == 0


def test_added_tokens_in_a_text_are_single_ids(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext| >", "<<|endoftext|>> x", "don't  <|ENDOFTEXT|>", "  <|endoftext|>  "]
    rows = P.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {i: [x for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == i for x in r["ids"]] for i in range(len(texts))}
    assert found == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert found[0] == [505, 220, 50256, 734, 0]
