import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from volframe.llm import packing, sentencepieces, token_counts, tokenizing


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_sentencepieces(spark, odd, odd_rows, library):
    want = sorted((str(i), len(ids := [1, *library.encode(t or ""), 2]), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids) for i, t in odd_rows)
    got = sentencepieces.encode(odd, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == want
    texts = dict(odd_rows)
    for r in got:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert r.covered_bytes == len(raw) and b"".join(raw[a:z] for a, z in zip(r.first_bytes, r.after_bytes, strict=True)) == raw


def test_random_strings(library):
    rng = random.Random(1)
    letters = " \n\tabcé▁ß漢😀.,!0\u200b\u0301"
    texts = ["", " ", "  ", "▁", *("".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000))]
    encoder = sentencepieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    n, ids, *_ = encoder.encode(texts)
    assert np.split(ids, np.cumsum(n)[:-1])[5].tolist() == library.encode(texts[5])
    assert ids.tolist() == [x for t in texts for x in library.encode(t)]


def normalizing_model(tmp_path, trim):
    """The public model with a compiled character map and other blanks: only its settings differ."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    try:
        made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
        other = pb.ModelProto()
        other.ParseFromString(made.serialized_model_proto())
    except (AttributeError, TypeError, RuntimeError) as e:
        pytest.skip(f"this library has no compiled map to lend: {e}")
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = trim
    at = tmp_path / "model"
    at.write_bytes(proto.SerializeToString())
    return str(at)


@pytest.mark.parametrize("trim", [True, False])
def test_character_map(tmp_path, trim):
    path = normalizing_model(tmp_path, trim)
    encoder = sentencepieces.PieceEncoder(path)
    texts = ["", "plain words", "ﬁne ① ｆｕｌｌ  wide", "  é ㍿ x  ", "e\u0301 and \u3000 blank", "a\u00a0b"]
    n, ids, first, after = encoder.encode(texts)
    assert ids.tolist() == [x for t in texts for x in encoder.library.encode(t)]
    at = 0
    for t, k in zip(texts, n, strict=True):
        raw, own = t.encode(), list(zip(first[at : at + k], after[at : at + k], strict=True))
        assert all(0 <= a <= z <= len(raw) for a, z in own) and [a for a, _ in own] == sorted(a for a, _ in own)
        at += k
    n, ids, first, after = encoder.encode(["x ﬁne"])
    pieces = [encoder.library.id_to_piece(int(i)) for i in ids]
    assert after[-1] == len("x ﬁne".encode()) and "".join(pieces) == "▁x▁fine"


def test_packing(spark, odd, odd_rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in odd_rows)
    rows = packing.pack(packing.cut(odd, "doc_id", "text"), "length").collect()
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    assert {(str(r.doc_id), r.start, tuple(r.ids)) for r in rows} == {(i, a, tuple(x[a : a + 4096])) for i, x in want for a in range(0, len(x), 4096)}
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_fill_is_best():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        cap = rng.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= cap}
        total, chosen = packing.fill(counts, cap)
        assert total == max(sums) == sum(k * n for k, n in chosen.items()) and all(n <= counts[k] for k, n in chosen.items())


def test_plan_uses_all():
    rng = random.Random(6)
    histogram = {rng.randint(1, 4096): rng.randint(1, 500) for _ in range(300)}
    patterns, n = packing.plan(histogram)
    used = {}
    for chosen, times in patterns:
        assert sum(k * m for k, m in chosen.items()) <= 4096
        for k, m in chosen.items():
            used[k] = used.get(k, 0) + m * times
    assert used == histogram and n == sum(t for _, t in patterns)
    assert n <= 1.02 * sum(k * m for k, m in histogram.items()) / 4096 + 1


def test_packing_nothing_and_nonsense(spark, none):
    assert packing.pack_documents(none).count() == 0
    with pytest.raises(Exception, match="must be"):
        packing.pack(spark.createDataFrame([(1, 5000)], "k long, length long"), "length").collect()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(odd, odd_rows, rule):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    got = {}
    for r in token_counts.count_tokens(odd, "doc_id", "text", rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_crossing)
    for i, t in odd_rows:
        if i is None:
            continue
        t = t or ""
        bounds = [0]
        for line in t.split("\n"):
            bounds.append(bounds[-1] + len(line) + 1)
        line_of = [k for k, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)) for _ in range(a, z)]
        want = {k: [0, 0] for k in range(len(bounds) - 1)}
        for a, z in lib.encode(t, add_special_tokens=False).offsets:
            own = [line_of[c] for c in range(a, max(z, a + 1))]
            who = {"first": own[0], "last": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]
            want[who][0] += 1
            want[who][1] += len(set(own)) > 1
        assert got[i] == {k: tuple(v) for k, v in want.items()}


def test_sections_given(spark):
    df = spark.createDataFrame([(1, "hello world again", [5, 11]), (2, None, None), (3, "x", [])], "doc_id long, text string, e array<int>")
    got = [(r.doc_id, r.section, r.first_char, r.after_char, r.n_tokens) for r in token_counts.count_tokens(df, "doc_id", "text", F.col("e")).orderBy("doc_id", "section").collect()]
    assert got == [(1, 0, 0, 5, 1), (1, 1, 5, 11, 1), (1, 2, 11, 17, 1), (2, 0, 0, 0, 0), (3, 0, 0, 1, 1)]
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, "doc_id", "text", F.col("e"), "none")


def test_odd_blanks():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = " \n\t\r\x0b\x0c\x1c\x85\u00a0\u2003\u3000aAéÉßΣς'sİ<|endoftext|>1２.,😀e\u0301"
    texts = ["", *("".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(2000)), "a<|endoftext|>b", "ΑΣ ΑΣ. Σ"]
    spans, plain = tokenizing.SpanEncoder(public_tokenizers.path("byte_bpe_50k.json")), tokenizing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    n, ids, first, after = spans.encode(texts)
    whole = [lib.encode(t, add_special_tokens=False) for t in texts]
    assert ids.tolist() == [x for e in whole for x in e.ids] and list(zip(first.tolist(), after.tolist(), strict=True)) == [o for e in whole for o in e.offsets]
    assert plain.encode(texts)[1].tolist() == [x for t in texts for x in words.encode(t, add_special_tokens=False).ids]


def test_empty_tables(none):
    assert sentencepieces.encode(none, "doc_id", "text").count() == 0 and token_counts.count_tokens(none, "doc_id", "text").count() == 0


def test_a_worker_keeps_few_words(monkeypatch):
    """What a task has learnt stays for the next, but no more than so many words: workers outlive their tasks."""
    monkeypatch.setattr(packing, "REST_WORDS", 100)
    tokenizing.shared.cache_clear()
    path = tokenizing.tokenizer_file(packing.TOKENIZER)
    rng = random.Random(5)
    texts = [" ".join(["often", "Seen,", *(f"w{rng.random()}" for _ in range(50))]) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], ["_key", "text"])
    first = list(packing._cut(iter([batch]), path, 4096, 2, True))
    store = tokenizing.shared(tokenizing.WordEncoder, path).store
    assert len(store.at) == 100 and {"often", "seen"} <= set(store.at)
    assert list(packing._cut(iter([batch]), path, 4096, 2, True)) == first
    store.rest(0)
    assert not store.at and list(packing._cut(iter([batch]), path, 4096, 2, True)) == first
    tokenizing.shared.cache_clear()


def test_words_are_looked_up_once_a_batch(monkeypatch):
    """A word that recurs in a batch is one chunk for the store, and words of letters need no pattern of the tokenizer."""
    encoder = tokenizing.WordEncoder(tokenizing.tokenizer_file(packing.TOKENIZER))
    texts = ["the End, été été the END", " the end the end "] * 50
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[:2]] * 50
    asked, rows = [], encoder.store.rows
    monkeypatch.setattr(encoder.store, "rows", lambda chunks, *a: asked.append(chunks) or rows(chunks, *a))
    monkeypatch.setattr(encoder, "_by_places", lambda chunks: pytest.fail(f"{chunks} by patterns") if set(chunks) - {"", ","} else tokenizing.WordEncoder._by_places(encoder, chunks))
    n, ids = encoder.encode(texts)
    assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
    assert [sorted(c) for c in asked] == [["", ",", "end", "the", "été"]]
    assert encoder.store.used[encoder.store.at["the"]] == 200


def test_random_words():
    """Any mix of letters, marks, blanks and special strings gets the ids that the library gives the whole text."""
    rng = random.Random(3)
    letters = ["<|endoftext|>", "<|", "'s", *"abzABZ .,!?;:\n\t\r\v\f\x1c\x85\xa0\u3000éÉe\u0301İßÿ×÷µª漢😀\0019-\u200b"]
    texts = ["", " ", "a.", "A. b. c.:!? d.", "<|ENDOFTEXT|>. X, Y.", *("".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000))]
    encoder = tokenizing.WordEncoder(tokenizing.tokenizer_file(packing.TOKENIZER))
    n, ids = encoder.encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
