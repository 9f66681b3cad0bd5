import plain
import public_tokenizers
from hypothesis import given, settings, strategies as st

from curricle.llm import trie_bpe as m

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODE = m._encoder(m.Vocabulary.read(PATH), 50_000)
PIECES = ["<|endoftext|>", "don't", "'re", "  ", "́", "\x1c", "\x85", "　", "᠎", "½", "漢字", "🎉", "ا١", "\n\n", "a\t"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=8))
def test_equals_the_library(parts):
    text = "".join(parts)
    n, ids, decoded = ENCODE([text])[0]
    want, back = plain.encode(text)
    assert (n, ids, decoded.decode()) == (len(want), ",".join(map(str, want)), back)


def test_rows(spark):
    rows = [(1, "Hello world, hello!"), (2, None), (3, ""), (None, "x" * 30_000), (1, "Hello world, hello!"), (4, "ab " * 20_000)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_tokens int").repartition(2)
    got = m.encode_documents(docs, PATH).collect()
    want = sorted(((i, len(plain.encode(t)[0]), plain.encode(t)[0], plain.encode(t)[1]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in got), key=str) == want
    digests = m.encode_documents(docs, PATH, digests=True, memory_words=1, batch_bytes=10).collect()
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (plain.sha(",".join(map(str, ids))), plain.sha(text)) for _, _, ids, text in want
    )
    assert m.encode_documents(docs.limit(0), PATH).count() == 0
