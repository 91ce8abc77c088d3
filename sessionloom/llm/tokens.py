"""Token ids from the public tokenizer files, with a cache of the pieces between white space that is bounded in bytes.

Neither of the two vocabularies has a token that crosses the white space before a piece, so a text's ids are those of
its pieces in order; each worker encodes a piece once. Texts with other white space than the simple case, or with what
may be a special token, go to the tokenizer whole. The ids are those of the tokenizer as its file defines it, special
tokens in a text included.
"""

from __future__ import annotations

import ctypes
import os
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np

#: Bytes of pieces from which on a worker keeps no more within a task, and those it keeps from task to task, all encoders
#: together; others are encoded anew for each group of texts. ENTRY: what one piece takes besides its characters and ids.
KEEP, HOLD, ENTRY = 64 << 20, 24 << 20, 190
#: Pieces encoded as one text.
JOIN = 64

MARK = "|"
#: White space other than space, line feed, tab and carriage return.
SPACES = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

ASCII_SPACES = SPACES[:6]


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1: there, lower case is one character for one and nothing composes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PieceEncoder:
    """Ids, as little-endian unsigned 32-bit bytes, of texts by one tokenizer file."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.simple = Tokenizer(self.tokenizer.model)  # for pieces of ASCII letters: the same merges without the splitting pattern
        self.simple.pre_tokenizer = WhitespaceSplit()
        self.spaced = kind == "byte"  # a piece takes the space before it along
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.heads = {token.content[:2].lower() for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that start with a space
        self.begins[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True
        self.marker = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.known: dict[str, bytes] = {"": b""}
        self.size = 0
        self.stops = dict(zip(".,", self._encode([".", ","]), strict=True))

    def odd(self, text: str) -> bool:
        """Whether the text has white space that is not simple, or the start of a special token."""
        spaces = ASCII_SPACES if text.isascii() else SPACES
        if any([c in text for c in spaces]) or any([x in text for x in self.heads]):
            return True
        return self.spaced and bool(text) and (any([c in text for c in ("\t", "\r", "  ", " \n", "\n ", "\n\n\n")]) or text[0] in " \n" or text[-1] in " \n")

    def _joined(self, pieces: list[str], tokenizer, lead: str, done: dict[str, bytes]) -> None:
        """Adds the ids of several pieces to a text; a space (as ``lead``), or a mark that none of them has, tells where each begins."""
        between = " " + lead.strip() if self.spaced else f" {MARK} "
        parts = [pieces[lo : lo + JOIN] for lo in range(0, len(pieces), JOIN)]
        for own, x in zip(parts, tokenizer.encode_batch_fast([(lead if self.spaced else "") + between.join(own) for own in parts], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, "<u4")
            raw, at = ids.tobytes(), (4 * np.flatnonzero(self.begins[ids] if self.spaced else ids == self.marker)).tolist()
            cuts = zip(at, [*at[1:], len(raw)], strict=True) if self.spaced else zip([0, *(k + 4 for k in at)], [*at, len(raw)], strict=True)
            done.update(zip(own, [raw[a:b] for a, b in cuts], strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces, none of them known."""
        known, letters, stopped, others = self.known, [], [], []
        for x in pieces:
            if not x.isascii():
                others.append(x)
            elif x.isalpha():  # needs no splitting
                letters.append(x)
            elif x[-1] in ".," and x[:-1].isalpha():  # a stop or comma after letters is a token of its own
                stopped.append(x)
            else:
                others.append(x)
        stems = [x[:-1] for x in stopped]
        letters += set(stems).difference(letters).difference(known)
        done: dict[str, bytes] = {}
        apart = [x for x in others if (x[0] == "\n" if self.spaced else MARK in x)]
        done.update(zip(apart, self._encode(apart), strict=True))
        self._joined([x for x in others if x not in done] if apart else others, self.tokenizer, " ", done)
        self._joined(letters, self.simple, "Ġ", done)
        done.update([(x, (done[stem] if stem in done else known[stem]) + self.stops[x[-1]]) for x, stem in zip(stopped, stems, strict=True)])
        return done

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        pieces: list[str] = []  # of all texts, one after the other
        bounds: list[tuple[int, int] | str] = []
        for text in texts:
            if self.odd(text):
                bounds.append(text)
                continue
            first = len(pieces)
            if self.spaced:
                pieces += ("\n" + text).replace("\n", " \n").split(" ") if text else []
            else:
                pieces += text.lower().split() if text.isascii() or _latin(text) else [x.lower() if x.isascii() else x for x in text.split()]
            bounds.append((first, len(pieces)))
        found: list[bytes | None] = list(map(self.known.get, pieces))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            own = [pieces[k] for k in missing]
            fresh = self._fresh(dict.fromkeys(own))
            for k, x in zip(missing, own, strict=True):
                found[k] = fresh[x]
            if self.size < KEEP:
                self.known.update(fresh)
                self.size += ENTRY * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))
        skip = 4 if self.spaced else 0  # the id of the line feed set before the text
        return [self._encode([x])[0] if isinstance(x, str) else b"".join(found[x[0] : x[1]])[skip:] for x in bounds]

    def trim(self, most: int) -> None:
        """Lets go of all but the first pieces seen, which are the common ones."""
        if self.size > most:
            size, count = 0, 0
            for piece, ids in self.known.items():
                size += ENTRY + len(piece) + len(ids)
                if size > most:
                    break
                count += 1
            self.known = dict(islice(self.known.items(), count))
            self.size = min(size, most)


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; kind "byte" for byte-level BPE, "word" for BPE with word ends."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]


def release() -> None:
    """At a task's end: the worker's encoders keep HOLD bytes between them and give the rest back to the system."""
    for own in _encoders.values():
        own.trim(HOLD // len(_encoders))
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it keeps what it likes
        pass


def groups(column, size: int = 1 << 20) -> Iterable[tuple[int, list[str]]]:
    """(first row, texts) of an Arrow string column in groups of about ``size`` characters. Null: empty."""
    own, first, n = [], 0, 0
    for k in range(len(column)):
        text = column[k].as_py() or ""
        own.append(text)
        n += len(text)
        if n >= size:
            yield first, own
            own, first, n = [], k + 1, 0
    if own:
        yield first, own
