"""BPE encoding and decoding that reuses content-defined chunks."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solarweave.llm.batches import by_batch, octets, spans
from solarweave.llm.gear import cuts

#: Chunks of some 500 bytes on average.
CHUNK_WIDTH, CHUNK_MOST = 320, 4096
#: A task keeps at most so many words, then those of its last texts alone; and so many bytes of long words and of chunks.
MOST_WORDS, MOST_CHUNK_BYTES = 120_000, 16 << 20
#: Bytes of text, and words, that are encoded at once.
SLICE, BATCH = 1 << 20, 5000
SPACE = b" \t\n\r\x0b\x0c"
MARKS = b".,;:!?*$%&#|"


class ChunkEncoder:
    """Encodes documents chunk by chunk, each distinct chunk once.

    Chunks end where a rolling hash says, anywhere in a text, so what documents share is cut
    alike. A chunk is kept as its head (up to the first white space), the encoding of the
    whole words inside, and its tail. Two chunks are joined by encoding the last tail and the
    next head as one piece: the piece grows over further chunks until white space stands on
    both sides. The tokenizer never merges across white space, so from there on the ids
    agree exactly with those of the whole text. Words inside chunks are encoded once as well.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.ends = np.array([n.endswith(b"</w>") for n in self.names])
        self.ids: dict[bytes, bytes] = {}
        self.texts: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = self.word_bytes = 0
        self.recent: set[bytes] = set()

    def _keep(self, word: bytes, ids: np.ndarray) -> None:
        self.ids[word] = ids.tobytes()
        self.texts[word] = b" ".join([self.names[i] for i in ids.tolist()])
        self.word_bytes += 20 * len(word) if len(word) > 64 else 0

    def _encode(self, words: list[bytes]) -> None:
        """Learn pieces. Words of letters alone have one token that ends a word, their last: they
        are encoded as one text and told apart by those tokens; all others go one by one."""
        plain, texts, rest = [], [], []
        for w in words:
            t = w.decode()
            if t.isalpha() and t.lower().isalpha():
                plain.append(w)
                texts.append(t)
            else:
                rest.append(w)
        for at in range(0, len(plain), BATCH):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[at : at + BATCH])], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(plain[at : at + BATCH]):
                rest += plain[at : at + BATCH]
                continue
            for w, a, b in zip(plain[at : at + BATCH], [0, *last.tolist()], last.tolist(), strict=False):
                self._keep(w, ids[a:b])
        for at in range(0, len(rest), BATCH):
            for w, e in zip(rest[at : at + BATCH], self.tokenizer.encode_batch_fast([w.decode() for w in rest[at : at + BATCH]], add_special_tokens=False), strict=False):
                self._keep(w, np.array(e.ids, "<u4"))

    def _learn(self, words: Iterable[bytes]) -> None:
        """Make sure that all these words are known. Marks after an ASCII letter are a piece of
        their own for the tokenizer, so a word with marks is made from word and marks."""
        new, made, self.recent = set(), [], set(words)
        for w in self.recent.difference(self.ids):
            base = w.rstrip(MARKS)
            if base and base != w and 97 <= base[-1] <= 122 and b"<|" not in w:
                made.append((w, base, w[len(base) :]))
                new.add(base)
                new.add(w[len(base) :])
            else:
                new.add(w)
        self._encode([w for w in new if w not in self.ids])
        for w, a, b in made:
            self.ids[w] = self.ids[a] + self.ids[b]
            self.texts[w] = self.texts[a] + b" " + self.texts[b]

    @staticmethod
    def _split(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
        """Head, whole words and tail of a chunk; None if it holds no white space."""
        words = chunk.split()
        if len(words) < 2 and not any(s in chunk for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")):
            return None
        head = words.pop(0) if words and chunk[0] not in SPACE else b""
        tail = words.pop() if words and chunk[-1] not in SPACE else b""
        return head, words, tail

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded) of each whole text. A-Z are lower-cased first, as the tokenizer would;
        not where the text could then hold a special token that it does not hold now."""
        if self.chunk_bytes > MOST_CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        if len(self.ids) > MOST_WORDS or self.word_bytes > MOST_CHUNK_BYTES:
            last = [w for w in self.recent if len(w) <= 64 and w in self.ids]
            self.ids, self.texts = {w: self.ids[w] for w in last}, {w: self.texts[w] for w in last}
            self.word_bytes = 0
        parts, fresh, joints = [], {}, []
        for text in texts:
            text = text if b"<|" in text else text.lower()
            ends = cuts(text, CHUNK_WIDTH, CHUNK_MOST)
            own = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            parts.append(own)
            for c in own:
                if c not in self.chunks and c not in fresh:
                    fresh[c] = self._split(c)
        for own in parts:
            carry = []
            for c in own:
                kept = fresh.get(c) or self.chunks.get(c)
                if kept is None:
                    carry.append(c)
                    continue
                joints.append(b"".join(carry) + kept[0])
                carry = [kept[-1]]
            joints.append(b"".join(carry))
        self._learn([w for s in fresh.values() if s for w in s[1]] + [j for j in joints if j])
        self.ids[b""] = self.texts[b""] = b""
        for c, s in fresh.items():
            self.chunk_bytes += 6 * len(c)
            self.chunks[c] = s and (s[0], b"".join(map(self.ids.__getitem__, s[1])), b" ".join(filter(None, map(self.texts.__getitem__, s[1]))), s[2])
        out, joint = [], iter(joints)
        for own in parts:
            ids, words = [], []
            for c in own:
                if kept := self.chunks[c]:
                    j = next(joint)
                    ids += (self.ids[j], kept[1])
                    words += (self.texts[j], kept[2])
            j = next(joint)
            ids.append(self.ids[j])
            words.append(self.texts[j])
            out.append((b"".join(ids), b" ".join(filter(None, words))))
        return out


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """keep and outputs of every row: n_tokens, ids (little-endian 32-bit), decoded, ids_sha256, decoded_sha256.

    path is the tokenizer's file, which every executor must have. The result equals that of
    the tokenizers library on each whole text, without special tokens added. Null texts count
    as empty: no tokens, empty text. Nothing is shuffled: a task shares chunks among its rows.
    """
    kinds = {"n_tokens": "long", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), F.col(f"`{text}`").alias("t"))
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + [f"{o} {kinds[o]}" for o in outputs])

    def start():
        encoder = ChunkEncoder(path)

        def each(batch: pa.RecordBatch) -> dict:
            texts, got = octets(batch.column("t")), []
            columns: dict[str, list] = {o: [] for o in outputs}
            for a, b in spans([len(t) for t in texts], SLICE):
                for ids, decoded in encoder.encode(texts[a:b]):
                    got = {"n_tokens": len(ids) // 4, "ids": ids}
                    if "decoded" in columns:
                        got["decoded"] = decoded.decode()
                    if "ids_sha256" in columns:
                        got["ids_sha256"] = hashlib.sha256(ids).hexdigest()
                    if "decoded_sha256" in columns:
                        got["decoded_sha256"] = hashlib.sha256(decoded).hexdigest()
                    for o in outputs:
                        columns[o].append(got[o])
            return {n: batch.column(n) for n in names} | columns

        return each

    return by_batch(rows, schema, start).toDF(*keep, *outputs)
