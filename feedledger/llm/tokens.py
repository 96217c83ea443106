"""Token ids of whole texts by a public byte-level BPE vocabulary of the tokenizers library."""

import re
from array import array
from functools import lru_cache

#: Letters and digits of the range below, where every Unicode version agrees on the classes.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t\n\r "
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+"
                    f"|[{_S}]+(?![^{_S}])|[{_S}]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)``. Latin-script texts are cut
    into pre-tokens here, so that the library's BPE model runs once for each different
    pre-token; any other text, and one that holds a special token, goes to the library whole.
    """

    #: Pre-tokens remembered by one worker before it starts anew (some 100 MB).
    REMEMBERED = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        model, letters, outer = self._whole.model, _byte_letters(), self

        class Memo(dict):
            def __missing__(self, word):
                if len(self) >= outer.REMEMBERED:
                    self.clear()
                shown = word.encode().decode("latin-1").translate(letters)
                ids = self[word] = array("I", [t.id for t in model.tokenize(shown)]).tobytes()
                return ids

        self._memo = Memo()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and not any(s in text for s in self._special):
            return b"".join(map(self._memo.__getitem__, _WORDS.findall(text)))
        return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept between tasks."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
