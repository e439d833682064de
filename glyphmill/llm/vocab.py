"""Public tokenizers in task processes: loaded once each, named by a path parameter."""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from glyphmill.worker import kept


def default_path(name: str) -> str:
    """Where the installed collection of public tokenizers keeps a file; asked on the machine that reads it."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def version(name: str) -> str:
    """Digest of a vocabulary file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    with open(default_path(name), "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    library = sentencepiece.__version__ if name.endswith(".model") else tokenizers.__version__
    return hashlib.sha256(f"{library} {content}".encode()).hexdigest()[:32]


def pieces(name: str):
    """A ``.model`` file as a sentencepiece processor."""

    def load():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=default_path(name))

    return kept(f"pieces:{name}", load)


_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r"!-&(-/:-@\[-`{-~"  # all but the apostrophe, which may join the letters after it
#: What any split pattern makes a piece; a line break only where something visible follows.
_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n(?=[^\n])")


def _plain(run: str) -> bool:
    """Latin letters only: one piece with the space before it, whatever the split pattern."""
    return run.isalpha() and (run.isascii() or max(run) < "\u0250")


class ByteBpe:
    """A byte-level ``tokenizers`` file, with a bounded memory of what follows single spaces.

    The split pattern of these vocabularies begins a piece at a single space before any visible character, whatever
    comes before, so a text is the concatenation of its runs cut there. A text in which a space meets more white space, or
    that has a special string, is encoded in one piece. Words not known yet are encoded together and told apart by the numbers of their pieces; a word
    with marks, digits or a line break behind it is put together from its pieces.
    """

    def __init__(self, name: str, size: int = 700_000):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = tokenizers.Tokenizer.from_file(default_path(name))
        # Two generations: what the younger one lacks is taken over from the elder, which is dropped in time.
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        #: Pieces without a space before them.
        self.inner: dict[str, bytes] = {}
        self.most = size
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Strings that the library takes out of a text before it splits it.
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        found = self.library.encode("".join([" " + w for w in words]), add_special_tokens=False)
        ids, piece = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids)
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        if len(starts) != len(words):
            return ((w, self.whole(" " + w)) for w in words)
        edges = [*(4 * starts).tolist(), len(ids)]
        return ((w, ids[a:b]) for w, a, b in zip(words, edges, edges[1:]))

    def _inner(self, piece: str) -> bytes:
        if piece not in self.inner:
            self.inner[piece] = self.whole(piece)
        return self.inner[piece]

    def _learn(self, runs: set[str]) -> set[str]:
        """Make the ids of ``runs`` known; returns those that cannot stand alone, since white space follows their space."""
        if len(self.inner) > self.most:
            self.inner = {}
        words, joined, blank = set(), [], set()
        for r in runs:
            if r in self.elder:
                self.known[r] = self.elder[r]
            elif _plain(r):
                words.add(r)
            elif not r or r[0].isspace():
                blank.add(r)
            else:
                pieces = _PIECE.findall(r)
                if sum(map(len, pieces)) == len(r):
                    joined.append((r, pieces))
                    if pieces[0] not in self.known:
                        words.add(pieces[0])
                else:
                    self.known[r] = self.whole(" " + r)
        new = list(words)
        for i in range(0, len(new), 1000):
            self.known.update(self._together(new[i : i + 1000]))
        for r, (first, *others) in joined:
            ids = self.known[first]
            for piece in others:
                ids += self.inner.get(piece) or self._inner(piece)
            self.known[r] = ids
        return blank

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        # Many small objects and no cycles: looking for some would cost a good part of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.elder = {}, self.known
        runs, ends, heads = [], [], []
        for t in texts:
            if self.special.search(t):
                heads.append(None)
            else:
                head, *rest = t.split(" ")
                heads.append(head)
                runs += rest
            ends.append(len(runs))
        ids = list(map(self.known.get, runs))
        blank = False
        if None in ids:
            new = [i for i, x in enumerate(ids) if x is None]
            blank = bool(self._learn({runs[i] for i in new}))
            for i in new:
                ids[i] = self.known.get(runs[i])
        out, start = [], 0
        for t, head, end in zip(texts, heads, ends):
            own = ids[start:end]
            out.append(self.whole(t) if head is None or blank and None in own else (self._inner(head) if _plain(head) else self.whole(head)) + b"".join(own))
            start = end
        return out


def in_groups(texts: Iterable, size: Callable[[object], int], most: int = 1 << 20) -> Iterator[list]:
    """Consecutive items in lists of about ``most`` bytes."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += size(t)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def byte_bpe(name: str) -> ByteBpe:
    return kept(f"byte_bpe:{name}", lambda: ByteBpe(name))
