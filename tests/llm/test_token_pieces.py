"""Texts are encoded in pieces: with the library's ids, and each piece once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer, models, normalizers, pre_tokenizers

from tabbridge.llm import tokens

# words, marks, white space of all kinds, other scripts, and parts of the file's added token
PARTS = [
    " ", " ", " ", "  ", "\n", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000",
    "\u180e", "\ufeff", "\u200b", "\x00", "\x1c", "\x7f", "<", "|", "<|endoftext|>", "<|endo", "ftext|>", "'s", "'ll", "'", "don't",
    "a", "the", "End", "É", "é", "ß", "×", "中文", "日本", "😀", "½", "٣", "1", "23", ".", ",", "...", "-", "\u201c", "\u2014", "e\u0301", "xyz",
]


@pytest.fixture(autouse=True)
def nothing_known(monkeypatch):
    monkeypatch.setattr(tokens, "_KNOWN", {}, raising=False)
    monkeypatch.setattr(tokens, "_PIECES", {}, raising=False)


def texts(count, most=14, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(count)]


def whole(path, given):
    tokenizer = Tokenizer.from_file(path)
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in given]


def test_ids_of_odd_texts():
    path, given = tokens.default_tokenizer(), texts(20_000)
    assert tokens.encode_texts(given, path) == whole(path, given)


def test_a_small_table_gives_the_same_ids(monkeypatch):
    path, given = tokens.default_tokenizer(), texts(400)
    for size in (0, 8_000):
        monkeypatch.setattr(tokens, "CACHE_BYTES", size)
        for start in range(0, len(given), 50):
            part = given[start : start + 50]
            assert tokens.encode_texts(part, path) == whole(path, part)
            assert all(x.volume() <= size for x in tokens._KNOWN.values())


@pytest.mark.parametrize("pieces", [1 << 18, 30, 1])
def test_batches_with_nulls_and_offsets(monkeypatch, pieces):
    monkeypatch.setattr(tokens, "PART_PIECES", pieces, raising=False)
    path, given = tokens.default_tokenizer(), pa.array([None, "", *texts(40), "", None])
    batches = [given, given.slice(0, 0), given.slice(0, 2), given.slice(3, 20), given.slice(41)]
    for batch in (*batches, given.cast(pa.large_string()).slice(7, 5)):
        got = []
        for ids, starts in tokens.encode_batch(batch, path):
            assert starts[0] == 0 and len(ids) == starts[-1]
            got += [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
        own = whole(path, [t or "" for t in batch.to_pylist()])
        assert got == [np.append(np.frombuffer(x, "<u4"), tokens.END).tolist() for x in own]


def test_the_library_gets_each_word_once(monkeypatch):
    given, encode = [], tokens._encode
    monkeypatch.setattr(tokens, "_encode", lambda tokenizer, text: given.append(text) or encode(tokenizer, text))
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghij", k=8)) for _ in range(200)]
    lines = [" ".join(rnd.choice(words) + rnd.choice(["", ",", ".", "!", "\n", " "]) for _ in range(40)) for _ in range(500)]
    path = tokens.default_tokenizer()
    assert tokens.encode_texts(lines, path) == whole(path, lines)
    # 20,000 words: of 200 each counts once behind a space and once at the start of a text
    assert sum(map(len, given)) < 5 * sum(map(len, words))


def test_added_tokens_are_not_divided(tmp_path):
    path = str(tmp_path / "added.json")
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    tokenizer.add_tokens([AddedToken(x, normalized=False) for x in ("tea.pot", "x-y", "Kg")])
    tokenizer.save(path)
    rnd = random.Random(2)
    parts = [*PARTS, "tea", ".pot", "tea.pot", "tea.", "x-", "x-y", "K", "g", "Kg", " Kg", " tea.pot"]
    given = ["".join(rnd.choice(parts) for _ in range(12)) for _ in range(3000)]
    assert tokens.encode_texts(given, path) == whole(path, given)


def test_files_of_another_kind_encode_whole_texts(tmp_path):
    spaced = Tokenizer.from_file(tokens.default_tokenizer())
    spaced.add_tokens([AddedToken("the tea", normalized=False), AddedToken("pot", rstrip=True, normalized=False)])
    lower = Tokenizer.from_file(tokens.default_tokenizer())
    lower.normalizer = normalizers.Lowercase()
    accent = Tokenizer.from_file(tokens.default_tokenizer())
    accent.add_tokens([AddedToken("é", normalized=False)])
    plain = Tokenizer(models.WordLevel({"the": 1, "tea": 2, "?": 3}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    given = ["see the tea there", "the  tea the tea", "pot  of TEA", "The tea, the pot ", "", *texts(200)]
    for name, tokenizer in (("spaced", spaced), ("lower", lower), ("accent", accent), ("plain", plain)):
        path = str(tmp_path / f"{name}.json")
        tokenizer.save(path)
        assert tokens.encode_texts(given, path) == whole(path, given), name
