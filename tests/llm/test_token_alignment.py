"""Token alignment against offsets compared one by one."""

import random
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortsmith.llm import token_alignment as A
from cohortsmith.llm import vocabulary as V

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizers():
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def byte_level():
    """The usual map of bytes to printable characters, undone."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(c): c for c in kept} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in kept)}


def brute(rows, tokenizers):
    t, sp = tokenizers
    undo, docs, count = byte_level(), [], Counter()
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [bytes(undo[c] for c in t.id_to_token(i)) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            docs.append((doc_id, [], [], [], ""))
            continue

        def ends(raw):
            at, out = 0, []
            for r in raw:
                at += len(r)
                out.append(at)
            return out

        end_a, end_b = ends(raw_a), ends(raw_b)
        shared = sorted(set(end_a) & set(end_b))
        def cut(ids, at_end):
            at, out = 0, []
            for e in shared:
                to = at_end.index(e, at) + 1
                out.append(ids[at:to])
                at = to
            return out

        both = list(zip(cut(a, end_a), cut(b, end_b)))
        parts = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in both]
        links = [(x[-1], y[-1]) for x, y in both]
        count.update(links)
        docs.append((doc_id, a, b, links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    most = Counter()
    for (_, y), c in count.items():
        most[y] = max(most[y], c)
    return sorted(((d, len(a), len(b), len(s), len(s), sum(count[p] == most[p[1]] for p in s), sum(count[p] for p in s), sha) for d, a, b, s, sha in docs), key=repr)


TEXTS = ["The quick brown fox jumps over the lazy dog.", "the the  the", " leading", "naïve café — Ünïcode 漢字 🙂", "a\nb\tc\r\n\n d", "<|endoftext|> and <s> </s> <0x0A>",
         "tab▁piece", None, "", "x", " ", "   ", "supercalifragilistic antidisestablishment", "word word word", "é   　 wide", "\x00 nul", "12345 67,890.12"]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "remembered": 7}])
def test_against_brute_force(spark, tokenizers, sizes):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "no id here"), (7, "again 7")]
    got = A.align(spark.createDataFrame(rows, SCHEMA), **sizes).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, tokenizers)


def test_real_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = A.align(docs).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, tokenizers)


def test_empty_table_and_clashing_columns(spark):
    assert A.align(spark.createDataFrame([], SCHEMA)).collect() == []
    wide = spark.createDataFrame([(1, "one two", 3, "x", 5, 6)], SCHEMA + ", n_a int, pairs string, block int, row int")
    assert A.align(wide).count() == 1


def test_windows_are_remembered():
    aligner = A.Aligner()
    _, _, _, first = aligner.document("one two three two one")
    assert len(first) == 5 and first[1] == first[3]
    before = len(aligner.texts)
    aligner.document("zero two three")
    assert len(aligner.texts) == before + 1


def test_stretches_give_the_ids_of_the_whole_text(tokenizers):
    """Cut at single blanks between visible characters, whatever stands beside them."""
    t, sp = tokenizers
    aligner, kinds = A.Aligner(), ["a", "Zz", "7", "12", ".", "'s", "'", "é", "漢", "🙂", "\n", "  ", "\t", "\u00a0", "\x1d", "\x85", "\u3000", "\u200b", "_", "-"]
    text = " ".join(x + y for x in kinds for y in kinds) + "".join(x + " " + y for x in kinds for y in kinds)
    for each in (text, text[::-1], text.replace(" ", "  ")):
        stretches = A._BETWEEN.split(each)
        assert [i for x in stretches for i in aligner.encode_a(" " + x)] == t.encode(" " + each, add_special_tokens=False).ids
        assert [i for x in aligner.encode_b(stretches) for i in x] == sp.encode(each)
    assert aligner.separable


def test_windows_of_stretches_are_those_of_the_whole_text():
    aligner, kinds = A.Aligner(), ["a", "Zz", "7", ".", "'s", "é", "漢", "🙂", "\n", "\t", "\u00a0", "\u200b", "-"]
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice([*kinds, " ", " ", "  ", " \n "]) for _ in range(rng.randint(1, 30)))
        whole = aligner._aligned(text, aligner.encode_a(" " + text), aligner.encode_b(text))
        n_a, n_b, _, found = aligner.document(text)
        assert (n_a, n_b, found) == (whole or (0, 0, []))


@pytest.mark.parametrize("char", [" ", "\n", "x", "　"])
def test_ids_of_very_long_runs(tokenizers, char):
    text = "x" + char * 60_000 + "y z"
    assert V.byte_encoder()(text) == tokenizers[0].encode(text, add_special_tokens=False).ids


def test_bytes_of_ids(tokenizers):
    undo = byte_level()
    assert all(bytes(undo[c] for c in tokenizers[0].id_to_token(i)) == b for i, b in enumerate(V.byte_tokens()))
