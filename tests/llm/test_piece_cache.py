"""The encoder's cache of pieces: a word is given to the library's model once, whatever marks follow it."""

from pathloom.llm import records
from pathloom.llm.queries import tokenizer_path


class Counted:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, text):
        self.asked.append(text)
        return self.model.tokenize(text)


def plain(encoder, texts):
    return [encoder.packed(encoder.lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_word_before_marks_is_tokenized_once():
    encoder = records.Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["a wordlike, wordlike. (wordlike; wordlike! wordlike? wordlike:", "wordlike\nwordlike wordlike\nend"]
    encoder.model = Counted(encoder.model)
    found = encoder.encode(texts)
    assert encoder.model.asked.count("\u0120wordlike") == 1
    assert found == plain(encoder, texts)


def test_odd_spaces_and_long_pieces():
    """Spaces that begin no piece stay with what is before them; long pieces are not kept."""
    encoder = records.Encoder(tokenizer_path("byte_bpe_50k.json"))
    long = "x1" * 40
    texts = ["", " ", "  ", "a  b", " a", "a ", "a  ", "a \n b", "a \u180eb c", "a \u3000b", "a\u00a0 b \t c  \n\n d", f"{long} {long}, {long}", "é ñandú, naïve. 漢字 漢字。", "a \x1c b"]
    for _ in range(2):
        assert encoder.encode(texts) == plain(encoder, texts)
    assert encoder.known and max(map(len, encoder.known)) <= records.CACHE_CHARS + 1
