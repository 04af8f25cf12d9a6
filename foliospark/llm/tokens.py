"""Ids of texts by a tokenizer file of the `tokenizers` library, every one by the library, with a store of what a worker met lately."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from foliospark.llm.common import worker_keeps

#: Chunks whose ids a worker keeps, about: they are dropped before a batch that finds more. About 200 bytes each.
KEPT = 600_000
#: Chunks that the library is given as one text: what a call costs beyond its text is then shared by many.
JOINED = 256
#: Texts that the library is given at once: what it says of each token takes many times the ids, and goes before the next are encoded.
AT_ONCE = 16
#: Characters that may follow a word in a chunk: none begins another part of a split or a special token, so a run of them is a part of its own.
STOPS = ".,!?;:*%$#&"
#: The first character beyond Latin-1.
LATIN = "Ā"


class Store:
    """Ids of whole texts. Files for which `divisible` holds have their texts cut by `cut` into chunks whose ids, in turn, are those of the text; what is not
    in the store is encoded by the library, many chunks in one text, and the library's offsets tell their ids apart. Other files, all where `chunked` is
    False, and texts that `cut` gives back as None, are encoded whole.

    Subclasses say when a file is divisible, how texts are cut, and with what white space a chunk stands beside others."""

    #: Whether a word of letters and its lower case have the same ids.
    folded = False
    #: Bytes of ids in front of a cut text's chunks that are not the text's own.
    lead = 0

    def __init__(self, path: str, chunked: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        self.chunked = chunked and self.divisible(json.loads(self.tokenizer.to_str()))
        self.kept: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {"": b""}

    @staticmethod
    def divisible(tokenizer: dict) -> bool:
        return False

    @staticmethod
    def cut(text: str) -> list[str] | None:
        return None

    @staticmethod
    def beside(chunk: str) -> str:
        raise NotImplementedError

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for k in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        texts = list(map(self.beside, chunks))
        groups = [texts[k : k + JOINED] for k in range(0, len(texts), JOINED)]
        out, width = [], self.kind.itemsize
        for k in range(0, len(groups), AT_ONCE):
            some = groups[k : k + AT_ONCE]
            for group, found in zip(some, self.tokenizer.encode_batch(["".join(g) for g in some], add_special_tokens=False)):
                cut = [0, *np.searchsorted([a for a, _ in found.offsets], np.cumsum([len(c) for c in group])).tolist()]
                ids = self.packed(found.ids)
                out += [ids[width * a : width * b] for a, b in zip(cut, cut[1:])]
        return out

    def _learn(self, new: set[str]) -> None:
        kept, stops, changed, lack = self.kept, self.stops, [], set()
        for c in new:
            core = c.rstrip(STOPS)
            if core.isalpha() and (core.isascii() or max(core) < LATIN):
                tail = c[len(core) :]
                if self.folded:
                    core = core.lower()
                lack.add(core)
                if core != c:
                    changed.append((c, core, tail))
            else:
                lack.add(c)
        asked = list(lack.difference(kept))
        kept.update(zip(asked, self._joined(asked)))
        tails = list({t for _, _, t in changed}.difference(stops))
        stops.update(zip(tails, self.whole(tails)))
        kept.update([(c, kept[core] + stops[t]) for c, core, t in changed])

    def fixed(self) -> dict[str, bytes]:
        """What is always in the store."""
        return {}

    def parts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        if not self.chunked:
            return self.whole(texts)
        if len(self.kept) > KEPT:
            self.kept.clear()
        self.kept |= self.fixed()
        cut = [self.cut(t) for t in texts]
        self._learn(set().union(*[c for c in cut if c]).difference(self.kept))
        whole = iter(self.whole([t for t, c in zip(texts, cut) if c is None]))
        get, lead = self.kept.__getitem__, self.lead
        return [next(whole) if c is None else b"".join(map(get, c))[lead:] for c in cut]


def encoder(kind: type[Store], path: str, chunked: bool) -> Store:
    """One for each worker process: its store serves the tasks that follow each other there. A task has a core of its own, so the library starts no threads
    there, whose memory would stay with the worker, unless TOKENIZERS_PARALLELISM says so."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_keeps((kind, path, chunked), lambda: kind(path, chunked))
