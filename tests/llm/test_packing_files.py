import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuespan.llm import packing, token_files

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = ["", None, "short one", "a b c " * 900, "İ <|endoftext|> ß", "short one", "same", "same", "x" * 5000, "\n\n  \t "]


def documents(spark, rows=None):
    rows = list(enumerate(TEXTS)) if rows is None else rows
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, length string")


def ids(path, text):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 0]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_pack_pieces_and_places(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id")]
    got = packing.pack_documents(documents(spark, rows), WORD, 64).collect()
    want = []
    for i, t in rows:
        own = ids(WORD, t)
        want += [(i, n, at, len(own[at:at + 64]), crc(own[at:at + 64])) for n, at in enumerate(range(0, len(own), 64))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64
    total = sum(r.length for r in got)
    assert len(filled) <= -(-total // 64) + 2


def test_pack_empty(spark):
    assert packing.pack_documents(documents(spark, []), WORD, 64).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_sum_of_squares_takes_the_least_sum(sizes):
    bins, places, made = packing.sum_of_squares(np.array(sizes), 20)
    level = {}
    for size, b, place in zip(sizes, bins.tolist(), places.tolist(), strict=True):
        assert level.get(b, 0) == place and place + size <= 20

        def squares(levels):
            gaps = [20 - v for v in levels.values() if v < 20]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        best = min(squares({**level, k: level.get(k, 0) + size}) for k in [*level, -1] if level.get(k, 0) + size <= 20)
        level[b] = place + size
        assert squares(level) == best
    assert len(level) == made


def test_files_round_trip(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id"), (-5, "low")]
    docs = documents(spark, rows)
    store = token_files.write(docs, BYTE)
    got = store.documents().collect()
    want = sorted((r[0] if r[0] is not None else -10 ** 18, len(ids(BYTE, r[1])), crc(ids(BYTE, r[1]))) for r in rows)
    assert want == sorted((r.doc_id if r.doc_id is not None else -10 ** 18, r.n_tokens, r.ids_crc32) for r in got)
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    fetched = store.fetch(spark.createDataFrame([(3,), (6,), (99,), (None,)], "doc_id long")).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in fetched) == sorted((i, ids(BYTE, t)) for i, t in rows if i in (3, 6))


def test_files_empty(spark):
    assert token_files.write(documents(spark, []), BYTE).documents().collect() == []


def test_another_dictionary_is_refused(spark):
    store = token_files.write(documents(spark), BYTE)
    try:
        token_files.TokenFile(f"{store.folder}/{store.files[0][1]}", b"other")
    except ValueError:
        return
    raise AssertionError("read with a wrong dictionary")


def test_the_library_sees_a_word_once_whatever_stands_behind_it():
    from cuespan.llm.library_ids import LibraryIds

    coder, plain, sent = LibraryIds(BYTE), Tokenizer.from_file(BYTE), []
    library = coder.plain

    class Counted:
        model = library.model

        def encode_batch_fast(self, pieces, **rest):
            sent.extend(pieces)
            return library.encode_batch_fast(pieces, **rest)

    coder.plain = Counted()
    texts = ["a word, word. word! it's word' x2 naïve; cm5 café½ ª, c. word", "word, word? a­"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [coder.encode([t])[0] for t in texts] == want
    assert sent.count(" word") == 1 and " word," not in sent and " it's" in sent


def test_many_words_are_not_cut_by_the_library_again():
    from cuespan.llm.library_ids import LibraryIds

    coder, plain, sent = LibraryIds(BYTE), Tokenizer.from_file(BYTE), []
    library = coder.plain

    class Counted:
        model = library.model

        def encode_batch_fast(self, pieces, **rest):
            sent.extend(pieces)
            return library.encode_batch_fast(pieces, **rest)

    coder.plain = Counted()
    words = [f"{a}{b}{c}" for a in ("na", "Über", "ñ", "ab") for b in ("ïve", "LL", "ªº", "e") for c in "abcdefghijklmnoprstuvwxyz"]
    text = "x" + " ".join(words) + "\n" + "\n".join(words[:50]) + " it's a2 \u00a0b, <|endoftext|>'s  c!"
    assert coder.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert not any(p.removeprefix(" ").isalpha() for p in sent) and " it's" in sent
    assert plain.encode(words[0], add_special_tokens=False).ids == np.frombuffer(coder.encode([words[0]])[0], "<u4").tolist()
