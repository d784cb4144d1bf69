"""The packing's encoder: a word is looked up once in a run of texts, whatever white space lies around it."""

from tokenizers import Tokenizer

from tracesift.llm import packing
from tracesift.llm.queries import tokenizer_path


class _Counted(dict):
    asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


def test_repeated_words_are_looked_up_once():
    direct, coder = Tokenizer.from_file(tokenizer_path()), packing._Encoder(tokenizer_path())
    texts = ["", " ", "\t\n\x0b\x0c\r one", "one  two. ", "\x1cone\x85two three four été!", " two. " * 500, "one One ONE one."]
    for _ in range(2):  # of new words, then of known ones
        coder.words.at = _Counted(coder.words.at)
        ids, n = coder.encode([t.encode() for t in texts])
        want = [direct.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert coder.words.at.asked <= len({w for t in texts for w in t.encode().split()}) + 1
    ids, n = coder.encode([])
    assert not len(ids) and not len(n)
