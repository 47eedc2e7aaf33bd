import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelake.llm import pieces as S
from pipelake.llm import tokencount as C
from pipelake.llm import tokenids as T
from pipelake.llm.queries import TOKENIZER_DIR

TEXTS = ["", None, " ", "  a", "a\n\nb", " \n x", "Hello, world! don't", "日本 語\x00", "a" * 3000, "x" * 300 + " " + "é" * 70, "the cat " * 2000, "<|endoftext|>", "tail "]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)


def greedy(word, pieces, most):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + most), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy():
    rng = random.Random(8)
    for _ in range(300):
        pieces = {tuple(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)}
        pieces = {tuple(map(ord, p)) + ((C.END,) if rng.random() < 0.5 else ()) for p in pieces} | ({(C.END,)} if rng.random() < 0.7 else set())
        machine = C.build_automaton(pieces)
        for _ in range(20):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode()
            assert machine.count(word) == greedy((*word, C.END), pieces, 6)


def test_token_counts(spark):
    path = f"{TOKENIZER_DIR}/word_bpe_49k.json"
    pieces = set(C.read_pieces(path))
    most = max(map(len, pieces))
    for r in C.count_tokens(docs(spark, TEXTS), path).collect():
        words = (TEXTS[r.doc_id] or "").encode().lower().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy((*w, C.END), pieces, most) for w in words))
    assert C.count_tokens(docs(spark, []), path).count() == 0


@pytest.fixture(scope="module")
def model():
    with open(f"{TOKENIZER_DIR}/byte_bpe_50k.json", encoding="utf-8") as file:
        return file.read()


def plain(model):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(model):
    rng = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", "é", "1", "'s", ".", "!", "\u00a0", "日", ",", "\0", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    encoder, reference = T.Encoder(model, bound=500), plain(model)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], encoder.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(ids, encoder.kind).tolist() == reference(text)


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 1 << 31], list(range(0, 70000, 7)) * 2])
def test_segments_give_any_token(ids):
    segment = T.Segment.open(T.pack(np.array(ids, np.uint32)))
    assert segment.tokens().tolist() == ids
    assert all(segment.token(i) == ids[i] for i in {*range(min(len(ids), 30)), *range(0, len(ids), 997), *([len(ids) - 1] if ids else [])})
    with pytest.raises(IndexError):
        segment.token(len(ids))


def test_documents_read_back(spark, model):
    frame = docs(spark, TEXTS).union(spark.createDataFrame([(None, "x", 1), (3, "y", 1)], "doc_id long, text string, n_tokens int"))
    found = T.read_documents(T.write_segments(T.encode_documents(frame, model, segment_tokens=500))).orderBy("start").collect()
    reference, start = plain(model), 0
    assert [r.doc_id for r in found] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    crc = lambda t: zlib.crc32(np.array([*reference(t), 0], "<u4").tobytes())
    for r in found:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id not in (None, 3):
            assert r.ids_crc32 == crc(TEXTS[r.doc_id])
    assert {r.ids_crc32 for r in found if r.doc_id == 3} == {crc("  a"), crc("y")}
    assert T.read_documents(T.write_segments(T.encode_documents(frame.limit(0), model))).count() == 0


def viterbi(word, table, model):
    best = [(0.0, 0, ())]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - model.longest), end):
            piece = word[start:end]
            if piece in table:
                options.append((best[start][0] + table[piece][1], -start, (table[piece][0],)))
            elif end - start == 1:
                options.append((best[start][0] + model.fallback, -start, tuple(model.bytes_at[b] for b in piece.encode())))
        total, start, ids = max(options)
        best.append((total, -start, ids))
    out, end = [], len(word)
    while end:
        out.append(best[end][2])
        end = best[end][1]
    return [i for ids in reversed(out) for i in ids]


def test_pieces_are_the_best_path_and_decode(spark):
    model = S.PieceModel.read(f"{TOKENIZER_DIR}/piece_bpe_32k.model")
    table = {p: (i, s) for i, (p, s, ok) in enumerate(zip(model.pieces, model.scores, model.usable, strict=True)) if ok}
    found = S.decode(S.encode(docs(spark, [*TEXTS, "a▁b"]), model), model).collect()
    assert len(found) == len(TEXTS) + 1
    for r in found:
        text = [*TEXTS, "a▁b"][r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == [i for w in S.words_of(text) for i in viterbi(w, table, model)]
        assert r.text == text.replace("▁", " ")
    assert {(r.doc_id, r.text) for r in S.encode(docs(spark, TEXTS[:9]), model, decoded=True).collect()} == {(i, t or "") for i, t in enumerate(TEXTS[:9])}
    assert S.encode(docs(spark, []), model).count() == 0


def test_a_lattice_task_gets_half_a_partition(spark):
    model, n = S.PieceModel.read(f"{TOKENIZER_DIR}/piece_bpe_32k.model"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = spark.createDataFrame([(k,) for k in S.bucket_keys(spark)], "route long").repartition(2 * n, "route")
    assert sorted(r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()) == [1] * (2 * n)
    plan = S.encode(docs(spark, TEXTS), model)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(route#\w+, (\d+)\)", plan)) == {str(2 * n)}


def test_pieces_decode_as_the_library_does(spark):
    import sentencepiece

    path = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
    model, library = S.PieceModel.read(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["The quick brown fox.", "Über 50 % é", "two  spaces"]
    for r in S.encode(docs(spark, texts), model).collect():
        assert library.decode(np.frombuffer(r.ids, "<u4").tolist()) == texts[r.doc_id]


def test_token_counts_leave_other_columns_alone(spark, tmp_path):
    path = f"{TOKENIZER_DIR}/word_bpe_49k.json"
    frame = spark.createDataFrame([(1, "some words", 7, 8, 9)], "doc_id long, text string, _counts int, _counts0 int, n_words int")
    (row,) = C.count_tokens(frame, path).collect()
    assert (row._counts, row._counts0, row.n_words) == (7, 8, 2)
