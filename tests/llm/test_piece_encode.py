"""Ids, spans and decoded texts against the public library, for the model as it is and for changed ones."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.frames import ODD, docs, rows, text
from tidemark.llm import piece_encode as M
from tidemark.llm.piece_model import BYTE, SPACE_MARK, UNUSED, USER_DEFINED, Decoder, Normalizer, fields, read_model

RAW = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def field(number, value):
    """One encoded field: an int as varint, bytes as they are."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def changed(kinds=None, extra=(), normal=None, trainer=None):
    """The model with other kinds of pieces, more pieces, other normaliser and trainer settings."""
    out, n = b"", 0
    for number, value in fields(RAW):
        if number == 1:
            if kinds and n in kinds:
                value += field(3, kinds[n])
            n += 1
        elif number == 2 and trainer:
            value += b"".join(field(k, v) for k, v in trainer.items())
        elif number == 3 and normal:
            value += b"".join(field(k, v) for k, v in normal.items())
        out += field(number, value)
    for piece, kind in extra:
        out += field(1, field(1, piece.encode()) + field(3, kind))
    return out


def charsmap(rule):
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return dict(fields(dict(fields(proto))[3]))[2]


BASE = read_model(RAW)
NAMES = {p: i for i, p in enumerate(BASE.pieces)}
STEPS = {NAMES[p]: UNUSED for p in ("th", "in", "▁t", "ion", "er") if p in NAMES}
MODELS = {
    "as it is": RAW,
    "nfkc": changed(normal={2: charsmap("nfkc")}),
    "nmt_nfkc_cf, squeezed": changed(normal={2: charsmap("nmt_nfkc_cf"), 4: 1}),
    "squeezed": changed(normal={4: 1}),
    "no prefix": changed(normal={3: 0}),
    "no bytes": changed(kinds={n: UNUSED for n, k in enumerate(BASE.kinds) if k == BYTE}, trainer={35: 0}),
    "unused steps": changed(kinds=STEPS),
    "letters beside signs": changed(extra=[("s-lo", UNUSED), ("é.", USER_DEFINED)]),
    "user pieces": changed(extra=[("<sep>", USER_DEFINED), ("lo▁mi", USER_DEFINED), ("é😀", USER_DEFINED)]),
    "user pieces, nfkc": changed(normal={2: charsmap("nfkc")}, extra=[("<sep>", USER_DEFINED), ("①", USER_DEFINED)]),
}
SAMPLES = [
    "",
    " ",
    "   ",
    "a",
    " a  b   c ",
    "The quick brown fox, the other thing in another nation.",
    "x" * 3000,
    "ab" * 700 + "  " * 300,
    "é😀漢字 ｶﾞ ① Å ﬁ   　 ​ ½ é",
    "▁a ▁▁ b▁c",
    "lo mi<sep> lo mi lo mi é😀<sep>",
    "tab\tline\nend\r\n\x00\x01\x7f",
    "<s></s><unk><0x0A>",
    "\U0001f468‍\U0001f469 \U00020000￿",
    *[text(60, i) for i in range(5)],
]


def spans_of(lib, t):
    return [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces]


def check(lib, encoder, decoder, t):
    ids, spans = encoder([t.encode()])[0]
    got = np.frombuffer(ids, "<u4").tolist()
    assert got == lib.encode(t, add_bos=True, add_eos=True), t
    assert decoder(got) == lib.decode(got), t
    assert [tuple(x) for x in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()] == spans_of(lib, t), t


@pytest.mark.parametrize("name", MODELS)
def test_same_as_the_library(name):
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODELS[name])
    model = read_model(MODELS[name])
    encoder, decoder = M.Encoder(model), Decoder(model)
    for t in SAMPLES:
        check(lib, encoder, decoder, t)

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("the in ion <sep>lo mi ①é😀▁  \t\n"), st.characters(exclude_categories=["Cs"])), max_size=60))
    def any_text(t):
        check(lib, encoder, decoder, t)

    any_text()


def test_many_texts_at_once():
    encoder = M.Encoder(BASE)
    raw = [s.encode() for s in SAMPLES * 3]
    assert encoder(raw) == [M.Encoder(BASE)([r])[0] for r in raw] == encoder(raw)


def test_any_ids_are_decoded_like_the_library():
    lib, decoder = sentencepiece.SentencePieceProcessor(model_proto=RAW), Decoder(BASE)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=30))
    def any_ids(ids):
        assert decoder(ids) == lib.decode(ids)

    any_ids()


def test_alignment_covers_the_source():
    made, source = Normalizer(read_model(MODELS["nfkc"]))("ﬁn ｶﾞ x".encode())
    assert made.decode() == f"{SPACE_MARK}fin{SPACE_MARK}ガ{SPACE_MARK}x"
    assert len(source) == len(made) + 1 and source[-1] == len("ﬁn ｶﾞ x".encode())
    assert (np.diff(source) >= 0).all()


def test_bytes_that_are_no_text():
    lib = sentencepiece.SentencePieceProcessor(model_proto=RAW)
    for raw in (b"a\xffb", b"\xe2\x96", b"ok \xc0\x80 \xed\xa0\x80"):
        ids, _ = M.Encoder(BASE)([raw])[0]
        assert np.frombuffer(ids, "<u4").tolist()[1:-1] == lib.encode(raw)


@pytest.mark.parametrize("clash", [False, True])
def test_tables(spark, clash):
    lib = sentencepiece.SentencePieceProcessor(model_proto=RAW)
    long = [(10, "lo mi " * 100_000), (11, "é" * 50_000), (12, "x" * 100_000)]
    table = [*ODD, *long, (5, "one"), (5, "one"), *[(100 + i, s) for i, s in enumerate(SAMPLES)]]
    got = rows(M.digests(M.encode(docs(spark, table, clash), BASE), BASE))

    def want(d, t):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        spans = np.array(spans_of(lib, t or ""), "<u4").tobytes()
        return d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode()), sha(spans)

    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r.values()) for r in got), key=key) == sorted((want(*r) for r in table), key=key)


def test_empty_table(spark):
    assert rows(M.digests(M.encode(docs(spark, []), BASE), BASE)) == []


def test_other_kinds_of_models_are_refused():
    with pytest.raises(ValueError):
        read_model(changed(trainer={3: 1}))
