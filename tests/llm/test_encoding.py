import hashlib
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import bpe, idfiles, lengths
from tidewright.llm.library import LibraryEncoder
from tidewright.llm.scratch import Scratch
from tidewright.llm.vocab import UnitMemo, read_ranks

RANKS = read_ranks(public.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LIBRARY = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
CODEC = bpe.Codec(RANKS)
TEXTS = st.text(alphabet=st.sampled_from(list("abcdehlorst ABC  \n\t.,!?'012éß日本 　\x85\x1c🙂")), max_size=120)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_tree_gives_the_librarys_ids(text):
    ids = REFERENCE.encode_ordinary(text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == text.encode()
    memo = UnitMemo(CODEC.encode_units, b"".join)
    assert np.frombuffer(memo([text, text])[1], "<u4").tolist() == ids


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=80))
def test_join_is_a_monoid_over_bytes(x, y):
    assert CODEC.join(CODEC.tree(x), CODEC.tree(y)) == CODEC.tree(x + y) == CODEC.merged(x + y)


def test_long_matches():
    for text in ("a" * 5000, "ab" * 3000, "z" * 4097 + "é" * 900, "!?" * 2000):
        assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)
        assert CODEC.merged(text.encode()) == CODEC.tree(text.encode())


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_units_give_the_librarys_ids(text):
    assert np.frombuffer(LIBRARY_ENCODER([text])[0], "<u4").tolist() == library_ids(text)


LIBRARY_ENCODER = LibraryEncoder(public.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ["<|endoftext|>", "a  <|endoftext|> b", "(hello) 'twas", " lead", "trail ", "   ", "a   b", " a b "])
def test_special_strings_and_spaces(text):
    assert np.frombuffer(LIBRARY_ENCODER([text])[0], "<u4").tolist() == library_ids(text)


def test_other_vocabularies_go_through_the_library():
    path = public.path("word_bpe_49k.json")
    texts = ["Hello World", "", "a  b"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in LibraryEncoder(path)(texts)] == want


def test_encode_and_decode_tables(docs, odd):
    df = docs(list(enumerate(odd)))
    table = bpe.encode(df)
    assert table.columns == [*[c for c in df.columns if c != "ids"], "ids"]
    back = {r.doc_id: (r.text, list(r.ids), bytes(r.decoded)) for r in bpe.decode(table).collect()}
    for text, ids, data in back.values():
        assert ids == REFERENCE.encode_ordinary(text or "") and data == (text or "").encode()


def test_digests(docs, odd):
    got = {r.doc_id: r for r in bpe.digests(docs([*enumerate(odd), (None, "x"), (2, "y")])).collect() if r.doc_id is not None and r.doc_id != 2}
    for i, text in enumerate(odd):
        if i != 2:
            ids = np.array(REFERENCE.encode_ordinary(text or ""), "<u4").tobytes()
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.digests(docs([])).count() == 0


def test_files_round_trip(spark, docs, odd, prose):
    rows = [(10 * i, prose(i, 30)) for i in range(40)] + [(5 + 10 * i, t) for i, t in enumerate(odd)] + [(None, "null id"), (390, "again")]
    folder = Scratch(spark, "t").path("files")
    manifest = idfiles.write(docs(rows), folder, file_docs=7)
    got = idfiles.read(manifest, folder).orderBy("start").collect()
    want = sorted((-1 if i is None else i, [*library_ids(t or ""), 2]) for i, t in rows)
    ids_of = [(-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got]
    assert sorted(ids_of) == want and [i for i, _ in ids_of] == [i for i, _ in want]
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in ids_of])[:-1]]).tolist()
    assert [r.start for r in got] == starts and [r.n_tokens for r in got] == [len(x) for _, x in ids_of]
    assert manifest.count() > 3
    assert [x.tolist() for x in idfiles.document(manifest, folder, 30)] == [[*library_ids(rows[3][1]), 2]]
    assert len(idfiles.document(manifest, folder, 390)) == 2 and idfiles.document(manifest, folder, 391) == []


def test_files_of_nothing(spark, docs):
    folder = Scratch(spark, "t").path("files")
    assert idfiles.read(idfiles.write(docs([]), folder), folder).count() == 0
    folder = Scratch(spark, "t").path("files")
    got = idfiles.read(idfiles.write(docs([(None, None)]), folder), folder, lambda x: zlib.crc32(x.tobytes()), "long", "crc").collect()
    assert [tuple(r) for r in got] == [(None, 0, 1, zlib.crc32(np.array([2], "<u4").tobytes()))]


def test_damaged_index_is_refused(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/f"
    manifest = idfiles.write(docs([(1, "some text"), (2, "more")]), folder)
    path = next((tmp_path / "f").glob("ids-*.tid"))
    data = bytearray(path.read_bytes())
    data[-30] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        idfiles.Reader(folder, manifest.first()["file"])


def test_length_histogram(spark, docs, odd, prose):
    rows = [(i, prose(i % 7, 10 + i % 9)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(odd)]
    sizes = [len(library_ids(t or "")) for _, t in rows]
    hist = lengths.histogram(lengths.lengths(docs(rows)))
    got = {r.n_tokens: r for r in hist.collect()}
    assert sorted(got) == sorted(set(sizes))
    for limit, r in got.items():
        assert r.docs == sizes.count(limit) and r.tokens == limit * r.docs
        assert r.docs_within == sum(s <= limit for s in sizes) and r.docs_over == sum(s > limit for s in sizes)
        assert r.tokens_over == sum(s for s in sizes if s > limit)
        assert r.truncated_tokens == sum(min(s, limit) for s in sizes) and r.lost_tokens == sum(max(s - limit, 0) for s in sizes)
        assert r.quantile == pytest.approx(r.docs_within / len(sizes))
    asked = {r.context_limit: r for r in lengths.answer(hist, [0, 5, 33, 10**6]).collect()}
    for limit, r in asked.items():
        assert r.truncated_tokens == sum(min(s, limit) for s in sizes) and r.docs_within == sum(s <= limit for s in sizes)
    assert lengths.quantile_length(hist, 0.5).first()[0] == sorted(sizes)[-(-len(sizes) // 2) - 1]
    assert lengths.histogram(lengths.lengths(docs([]))).count() == 0
    assert hist.agg(F.sum("docs")).first()[0] == len(rows)
