"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The sufficient lookahead of a merge list is the number of bytes right of a token that can still change
whether the token forms. A merge can only be disturbed by a merge of lower rank at an overlapping place,
which in turn can only be disturbed by one of yet lower rank; following these overlaps in rank order
gives the bound. The encoder holds a buffer of a few lookaheads, emits every token that ends at least
one lookahead before the buffer's end, and drops the emitted bytes, so memory does not grow with the text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import map_rows

#: The characters that count as white space for the normaliser.
SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Words that one worker remembers before it starts anew, and their length; characters of a text, and words of a digest, that it holds at a time.
REMEMBERED, SHORT, CHUNK, HELD = 300_000, 64, 1 << 16, 1 << 13
#: A merge is kept as one number: its rank, and the id it makes in the low bits.
MASK, NONE = (1 << 20) - 1, 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


@lru_cache(maxsize=2)
def _own_tables(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in {**self.ids, **self.special}.items()}
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.end] for c in letters]
        self.pairs: dict[int, int] = {}
        self.order: list[tuple[str, str]] = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        for rank, (a, b) in enumerate(self.order):
            self.pairs.setdefault(self.ids[a] << 20 | self.ids[b], (rank + 1) << 20 | self.ids[a + b])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = {i: len(s.removesuffix(self.end) if self.end else s) for s, i in self.ids.items()}


def sufficient_lookahead(order: list[tuple[str, str]], end: str = "") -> int:
    """Bytes after a token's end that decide whether it stands, for merges in rank order.

    reach[t] is that number for the token t alone: the maximum, over tokens of lower rank that can overlap
    it, of how far the other token's end and its own reach go beyond t's end. Raises ValueError when a merge
    comes before one that makes its parts, as the bound holds for ordered lists only.
    """
    mark = (lambda s: s.removesuffix(end) + "\0" if end and s.endswith(end) else s)
    reach: dict[str, int] = {}
    starts: dict[str, int] = {}  # by proper prefix: how far the token goes beyond it, with its reach
    ends: dict[str, int] = {}  # by proper suffix: the token's reach
    inside: dict[str, int] = {}  # by whole token of higher rank: how far one that holds it goes beyond it
    later = {mark(a + b) for a, b in order}
    for a, b in order:
        a, b = mark(a), mark(b)
        t, n = a + b, len(a) + len(b)
        if any(len(x.rstrip("\0")) > 1 and x not in reach for x in (a, b)):
            raise ValueError("merges are not in the order of their parts")
        if t in reach:
            continue
        far = max(0, inside.get(t, 0))
        for k in range(n):
            far = max(far, starts.get(t[k:], 0))
            far = max(far, ends.get(t[: n - k], 0) - k)
            for j in range(k + 2, n + 1):
                far = max(far, reach.get(t[k:j], 0) - (n - j))
        reach[t] = far
        for k in range(1, n):
            starts[t[:k]] = max(starts.get(t[:k], 0), n - k + far)
            ends[t[k:]] = max(ends.get(t[k:], 0), far)
        for k in range(n):
            for j in range(k + 2, n + 1):
                if (p := t[k:j]) in later and p not in reach:
                    inside[p] = max(inside.get(p, 0), n - j + far)
    return max([1, *reach.values()])


class Encoder:
    """Text to ids, pre-token by pre-token."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int):
        self.v, self.lookahead = vocabulary, lookahead
        self.space = regex.compile(f"[{SPACE}]+")
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
        self.memo: dict[str, tuple[str, str, int]] = {}
        self.merged: dict[str, list[int]] = {}
        self.assigned: set[str] = set()
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges to a list of ids, lowest rank first and leftmost of equals."""
        if len(ids) > 200:
            return self.merge_long(ids)
        pairs, none = self.v.pairs, NONE
        get = pairs.get
        ids, found = list(ids), [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            ids[i : i + 2] = [new := best & MASK]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(found):
                found[i] = get(new << 20 | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) and links between neighbours."""
        get, n = self.v.pairs.get, len(ids)
        ids, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(hit, i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            hit, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = hit & MASK, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (hit := get(ids[p] << 20 | ids[q])):
                    heapq.heappush(heap, (hit, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def stream(self, letters: Iterable[int]) -> Iterator[int]:
        """Ids of one pre-token given as base ids, holding at most a few lookaheads of them."""
        hold, room = [], 4 * self.lookahead
        for x in letters:
            hold.append(x)
            if len(hold) >= room:
                done, kept = 0, self.merge(hold)
                for t in kept:
                    if done + self.v.size[t] > len(hold) - self.lookahead:
                        break
                    done += self.v.size[t]
                    yield t
                if done:
                    hold = hold[done:]
                room = len(hold) + 3 * self.lookahead
        yield from self.merge(hold)

    def one(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        base = [self.v.inner[b] for b in raw[:-1]] + [self.v.last[raw[-1]]]
        return self.merge(base) if len(base) <= 4 * self.lookahead else list(self.stream(base))

    def chunks(self, text: str) -> Iterator[str]:
        """The text in pieces that begin with white space, at which neither pre-tokens nor composed characters nor special tokens go on."""
        at = 0
        while at < len(text):
            gap = self.space.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            end = gap.start() if gap else len(text)
            yield text[at:end]
            at = end

    def settled(self, word: str) -> bool:
        """Whether this Python holds all characters of a word assigned; those that it does not, others may know."""
        if not self.assigned.issuperset(word):
            new = set(word) - self.assigned
            if any(unicodedata.category(c) == "Cn" for c in new):
                return False
            self.assigned |= new
        return True

    def runs(self, text: str) -> Iterator[list[str] | int]:
        """The runs of anything but white space of a text, some at a time, or the id of a special token.

        No pre-token has white space, and no character is composed or classed by what is beyond it, so each run is cut by itself.
        """
        for chunk in self.chunks(text):
            parts = self.v.split_special.split(chunk) if any(s in chunk for s in self.v.special) else [chunk]
            for k, part in enumerate(parts):
                if k % 2:
                    yield self.v.special[part]
                elif any(c in part for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space too
                    yield [w for w in self.space.split(part) if w]
                else:
                    yield part.split()

    def cut(self, run: str) -> list[str]:
        """The pre-tokens of a run."""
        if run.isascii():
            return self.word.findall(run.lower())
        if self.settled(run):
            return self.word.findall(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())
        # characters newer than this Python's tables: the vocabulary's own tables say how they are written and classed
        own = _own_tables(self.v.path)
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8") for w, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(run))]

    def ids_of(self, word: str) -> list[int]:
        """The ids of a pre-token, remembered if it is short."""
        if (ids := self.merged.get(word)) is None:
            ids = self.one(word)
            if len(word) <= SHORT:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                self.merged[word] = ids
        return ids

    def pieces(self, text: str, decoder: Decoder) -> Iterator[list[tuple[str, str, int]]]:
        """Some at a time, for each run (of a long one, for each pre-token): its ids as text, its decoded text, their number."""
        say = lambda ids: (" ".join(map(str, ids)), decoder.plain(ids), len(ids))
        memo = self.memo
        for runs in self.runs(text):
            if isinstance(runs, int):
                yield [say([runs])]
                continue
            for k in range(0, len(runs), HELD):
                out = list(map(memo.get, some := runs[k : k + HELD]))
                if None not in out:
                    yield out
                    continue
                found, out = out, []
                for run, hit in zip(some, found):
                    if hit is None and len(run) > SHORT:
                        for w in self.cut(run):
                            out.append(say(self.ids_of(w)))
                            if len(out) >= HELD:
                                yield out
                                out = []
                        continue
                    if hit is None and (hit := memo.get(run)) is None:
                        hit = say([i for w in self.cut(run) for i in self.ids_of(w)])
                        if len(memo) >= REMEMBERED:
                            memo.clear()
                        memo[run] = hit
                    out.append(hit)
                if out:
                    yield out

    def encode(self, text: str) -> list[int]:
        out = []
        for runs in self.runs(text):
            out += [runs] if isinstance(runs, int) else [i for run in runs for w in self.cut(run) for i in self.ids_of(w)]
        return out


class Decoder:
    """Ids to text, one id at a time.

    plain() writes the vocabulary's own strings with a space between them, which is what a file without a
    decoder asks for. feed() is the byte machine: it turns tokens into bytes, word ends into spaces, and
    gives out text as soon as its UTF-8 bytes are whole; ill-formed bytes become U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary):
        import codecs

        self.v = vocabulary
        self.bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def plain(self, ids: list[int]) -> str:
        names = self.v.names
        return " ".join([names[i] for i in ids])

    def feed(self, token: int) -> str:
        name = self.v.names[token]
        if name in self.v.special:
            return self.machine.decode(b"", True) + name
        ended = bool(self.v.end) and name.endswith(self.v.end)
        raw = bytes(self.bytes_of[c] for c in (name.removesuffix(self.v.end) if ended else name))
        return self.machine.decode(raw + b" " * ended)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def _loaded(path: str, lookahead: int) -> tuple[Encoder, Decoder]:
    v = Vocabulary(path)
    return Encoder(v, lookahead), Decoder(v)


def lookahead_of(path: str) -> int:
    v = Vocabulary(path)
    return sufficient_lookahead(v.order, v.end)


def _by_id(df: DataFrame, run, id_col: str, made: str) -> DataFrame:
    """mapInPandas over (id, ...), the id of any type travelling as text where it is a number."""
    kind = df.schema["id"].dataType.simpleString()
    through = df.withColumn("id", F.col("id").cast("string")) if kind in ("bigint", "int", "smallint", "tinyint") else df
    out = through.mapInPandas(run, f"id {through.schema['id'].dataType.simpleString()}, {made}")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: (id, ids array<int>). Null text counts as empty; a null id is kept; texts of any length; an empty table gives an empty one; other columns are ignored."""
    ahead = lookahead_of(vocabulary_path)

    def run(batches):
        enc, _ = _loaded(vocabulary_path, ahead)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [enc.encode(t) for t in b["text"]]})

    return _by_id(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), run, id_col, "ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of id lists through the byte machine: (id, text). Null lists give empty text; a null id is kept; an empty table gives an empty one; other columns are ignored."""

    def run(batches):
        v = Vocabulary(vocabulary_path)
        for b in batches:
            out = []
            for ids in b["ids"]:
                d = Decoder(v)
                out.append("".join([d.feed(int(i)) for i in (ids if ids is not None else [])]) + d.finish())
            yield pd.DataFrame({"id": b["id"], "text": out})

    return _by_id(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, id_col, "text string")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, in one narrow pass without a shuffle.

    Digests are fed as tokens come, a few thousand at a time, so that nothing but the text itself grows with it. Null text counts as empty: no
    tokens, digests of the empty string. Repeated rows have equal results, an empty table gives no rows, ties do not arise and extra columns, whatever
    their names, are ignored.
    """
    ahead = lookahead_of(vocabulary_path)

    def one(enc, dec, text):
        digests, n, lead = (hashlib.sha256(), hashlib.sha256()), 0, ""
        for hits in enc.pieces(text, dec):
            if not hits:
                continue
            ids, names, counts = zip(*hits)
            n += sum(counts)
            for digest, told in zip(digests, (ids, names)):
                digest.update((lead + " ".join(told)).encode("utf-8"))
            lead = " "
        return n, digests[0].hexdigest(), digests[1].hexdigest()

    def run(batches):
        enc, dec = _loaded(vocabulary_path, ahead)
        for b in batches:
            rows = [(doc, *one(enc, dec, text)) for doc, text in zip(b["doc_id"], b["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(cols, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
