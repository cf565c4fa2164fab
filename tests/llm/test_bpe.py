import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuespan.llm import bpe

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
HARD = ["", " ", "Hello <|endoftext|> Wörld's 12!!", "a<|startoftext|>B", "<|ENDOFTEXT|> x", "I'LL we've  \n\n don't",
        "ΣΑΣ İstanbul ǅ ﬁ", "e\u0301 \u00e9", "\x1c\x1d a\x85b\u2028c", "猫 🙂 ٣", "x" * 3000, "a\r\n\tb\u00a0 c   ",
        "\u2026\u2014\u201cq\u201d", "\u00ad\u200b", "\u00bd\u00b2"]


def ids_by_method(path, text, lex=None):
    v = bpe.vocabulary(path)
    chunks = v.chunks(text)
    ids = bpe.resolve(v, lex, set(chunks))
    return [i for c in chunks for i in ids[c]]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_hard_texts_as_the_library(path):
    library = Tokenizer.from_file(path)
    for text in HARD:
        assert ids_by_method(path, text) == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    for path in (WORD, BYTE):
        assert ids_by_method(path, text) == bpe.vocabulary(path).library.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=40), st.lists(st.binary(max_size=6)))
@settings(max_examples=100, deadline=None)
def test_lexicon_holds_just_its_words(tmp_path_factory, entries, others):
    file = tmp_path_factory.mktemp("lex") / "lexicon"
    file.write_bytes(bpe.compile_lexicon(entries))
    lex = bpe.Lexicon(str(file))
    words = [w for w in {*entries, *others}]
    for word, number in zip(words, lex.numbers(words).tolist(), strict=True):
        assert (number >= 0) == (word in entries and word != b"")
        if number >= 0:
            assert lex.ids_of(number) == entries[word]


def test_suffixes_are_shared():
    data = bpe.compile_lexicon({b"tapping": [1], b"topping": [2], b"zapping": [3]})
    states = int.from_bytes(data[4:8], "little")
    assert states == 9  # root, t, z and the shared tail


def test_query_against_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*HARD, None, HARD[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.digests(docs, WORD, words=5).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, WORD, words=5), WORD).collect()}
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(want.encode()).hexdigest() and back[i] == want


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), WORD).collect() == []


def test_every_plain_character():
    plain = [chr(c) for c in range(0x2100) if not bpe.ODD.search(chr(c))]
    for path in (WORD, BYTE):
        library = bpe.vocabulary(path).library
        for c in plain:
            text = f"a{c}1 {c}{c}b {c} 'S{c}  "
            assert ids_by_method(path, text) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_short_and_long_words_are_joined_alike(word):
    vocab = bpe.vocabulary(WORD)
    ids = [vocab.first[b] for b in word]
    ids[-1] = vocab.last[word[-1]]
    assert vocab._join_short(list(ids)) == vocab._join(list(ids))


def test_letters_and_one_other_character_need_no_pattern():
    vocab = bpe.Vocabulary(WORD)
    chunks = ["word", "naïve", "word,", "don't", "word'", "x²", "ª", "café½", "5cm", "cm5", "ȧ", "été!", "­", "abc­", "a,,"]
    asked = []

    class Counted:
        def findall(self, text):
            asked.append(text)
            return pattern.findall(text)

    pattern, vocab.pattern = vocab.pattern, Counted()
    assert [vocab.words(c) for c in chunks] == [[w.encode() for w in pattern.findall(c)] for c in chunks]
    assert "word" not in asked and "word," not in asked and "don't" in asked


def test_words_merged_side_by_side_are_those_merged_alone(monkeypatch):
    import random

    monkeypatch.setattr(bpe, "BLOCK", 7)
    rng = random.Random(4)
    for path in (WORD, BYTE):
        vocab = bpe.vocabulary(path)
        words = [b"", b"a", b"\xc3", *(bytes(rng.choice(b"etaoinshr\xc3\xa9 ,1") for _ in range(rng.randrange(1, 40))) for _ in range(400)),
                 b"the", b"aaaaaaaaaaaa", b"understanding"]
        assert vocab.merge_all(words) == [vocab.merge(w) for w in words]
    assert vocab.merge_all([]) == []


def test_ids_of_many_words_are_read_at_once(tmp_path):
    entries = {b"ab": [3, 4], b"b": [7], b"bcd": [1, 2, 9]}
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(entries))
    lex = bpe.Lexicon(str(tmp_path / "lexicon"))
    words = [b"bcd", b"b", b"ab", b"b"]
    assert lex.all_ids(lex.numbers(words)) == [entries[w] for w in words]
    assert lex.all_ids(lex.numbers([])) == []
