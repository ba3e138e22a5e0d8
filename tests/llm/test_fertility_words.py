"""Words are cut as they are one by one; those used twice are cut once a worker."""

import itertools
from types import SimpleNamespace

import pyarrow as pa

from larder.llm import common, fertility

PLAIN = ["the", "of", "'s", "don't", "|", "123", "4,5", "...", "Épée", "день", "中文字", "é", "̈x", "▁", "▁▁a", "<s>", "a\N{NO-BREAK SPACE}b", "🎉", "\N{REPLACEMENT CHARACTER}", "#" * 70]
WHITE = ["\N{NO-BREAK SPACE}", "a\N{NO-BREAK SPACE}", "\N{NO-BREAK SPACE}b", "\N{IDEOGRAPHIC SPACE}\N{IDEOGRAPHIC SPACE}", "\x1cc", "\x85", " d "]


def one_by_one(vocab, word):
    text = word.decode("utf-8", "replace")
    return vocab.pieces.encode(text), len(vocab.bytes.encode_ordinary(" " + text))


def check(vocab, words):
    number = vocab.numbers(words)
    ids, n = vocab.piece_ids(number)
    at = 0
    for w, i, k in zip(words, number.tolist(), n.tolist(), strict=True):
        assert (ids[at : at + k].tolist(), int(vocab.n_bytes[i])) == one_by_one(vocab, w), w
        at += k
    assert at == len(ids)


def test_words_are_cut_as_alone(monkeypatch):
    monkeypatch.setattr(fertility, "CACHE", -1)  # nothing is remembered
    vocab = fertility.Vocabularies(common.tokenizer_dir())
    check(vocab, [])
    check(vocab, [w.encode() for w in PLAIN])
    check(vocab, [b"x\xff", b"\xe4\xb8", "é".encode()])
    for pair in itertools.permutations([w.encode() for w in PLAIN[:4] + WHITE], 2):
        check(vocab, list(pair))


def test_frequent_words_are_cut_once(monkeypatch):
    monkeypatch.setattr(fertility, "CACHE", 60)
    vocab = fertility.Vocabularies(common.tokenizer_dir())
    pieces, cut = vocab.pieces, []
    vocab.pieces = SimpleNamespace(encode=lambda some, **more: [cut.extend([some] if isinstance(some, str) else some), pieces.encode(some, **more)][1])
    often = [b"often%d" % i for i in range(20)]
    for k in range(10):
        vocab.numbers([b"once%d" % i for i in range(50 * k, 50 * k + 50)] + often + often)
    assert len(cut) == 10 * 50 + 20
    vocab.pieces = pieces
    check(vocab, often + [b"once499"])
    for k in range(3):  # too many that are used twice: all are forgotten
        check(vocab, [b"twice%d" % i for i in range(80 * k, 80 * k + 80)] * 2)
    assert len(vocab.number) <= 60 + 80


def test_measures_do_not_depend_on_what_is_remembered(monkeypatch):
    texts = ["the cat " * 30, None, "", "\n\n", "a\n \x0bb\n" * 9 + "\N{NO-BREAK SPACE} x", *(f"word{i} день the {i * 7919} of" * (1 + i % 3) for i in range(400))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([None if i % 5 else "en" for i in range(len(texts))], pa.string()), pa.array(texts, pa.string())], names=["doc_id", "lang", "text"])
    monkeypatch.setattr(fertility, "_ready", {})
    docs = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, schema: run))
    run = fertility.measures(docs, common.tokenizer_dir())
    whole = [r for b in run(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(fertility, "CACHE", 100)
    monkeypatch.setattr(fertility, "_ready", {})
    assert [r for b in run(batch.slice(i, 7) for i in range(0, len(texts), 7)) for r in b.to_pylist()] == whole
    assert [r["n_words"] for r in whole[:5]] == [60, 0, 0, 0, 20] and whole[1]["entropy"] is None
