"""Exact token counts at every prefix of a text, stored once, and token ids, both put together from white-space chunks."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: the split pattern of the tokenizer file
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# characters that are their own normal form and have one lower-case character each
SIMPLE = re.compile("[!-~¡-¬®-įı-ɏ]*")
# every white-space character; the tokenizer drops them and never joins what stands on either side
GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for str.split only
PIECES_OF_LINES = regex.compile(PIECES.pattern + r"|\n")
END = "</w>"
LONG = 64  # characters from which a piece's counts are stepped along instead of asked for all its beginnings
BATCH = 5_000


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


LETTERS = _byte_letters()


def _letters(text: str) -> str:
    return "".join(map(LETTERS.__getitem__, text.encode("utf-8")))


@cache
def second_characters() -> frozenset[str]:
    """Characters that may combine with the one before them although they start a cluster themselves."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    jamo = map(chr, range(0x1161, 0x1200))
    return frozenset(jamo) | {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}


class Vocabulary:
    """A tokenizer file with word ends: the library's encoder, and its merges for prefix counts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        # the same model on pieces that are split and normalised already, one a line
        self.lean = Tokenizer(self.encoder.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ids = self.encoder.get_vocab()
        special = sorted((t.content for t in self.encoder.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.ends = np.zeros(max(self.ids.values()) + 1, bool)
        self.ends[[n for t, n in self.ids.items() if t.endswith(END)]] = True
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        # by the last two characters (or the only one) of tokens: their lengths, longest first
        lengths: dict[str, set[int]] = {}
        for t in self.ids:
            end = END if t.endswith(END) else ""
            body = t.removesuffix(END)
            for tail in {body[-2:], body[-1:]}:
                lengths.setdefault(tail + end, set()).add(len(body))
        for tail, found in lengths.items():
            if len(tail.removesuffix(END)) == 2:
                found.add(1)
        self.reach = {tail: sorted(found, reverse=True) for tail, found in lengths.items()}
        self._path = path
        self._ranks: dict[tuple[str, str], int] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of pieces of the split, and where each piece's ids end (its last token is a word's end)."""
        ids = np.array(self.lean.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.flatnonzero(self.ends[ids]) + 1

    @property
    def ranks(self) -> dict[tuple[str, str], int]:
        if not self._ranks:
            import json

            with open(self._path, encoding="utf-8") as f:
                merges = json.load(f)["model"]["merges"]
            self._ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(merges)}
        return self._ranks

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge procedure itself: again and again the pair of lowest rank, leftmost first."""
        ranks, none = self.ranks, 1 << 60
        found = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
        while found and (rank := min(found)) < none:
            at = found.index(rank)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del found[at]
            if at:
                found[at - 1] = ranks.get((symbols[at - 1], symbols[at]), none)
            if at < len(found):
                found[at] = ranks.get((symbols[at], symbols[at + 1]), none)
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(END):
            body = token.removesuffix(END)
            return [*body[:-1], body[-1] + END]
        return list(token)

    def alone(self, token: str) -> bool:
        """The token is what its own characters merge to."""
        if (out := self._alone.get(token)) is None:
            out = self._alone[token] = self.merged(self._symbols(token)) == [token]
        return out

    def follows(self, left: str, right: str) -> bool:
        """The two stay apart where they meet, so right can follow left in an encoding."""
        if (out := self._pairs.get((left, right))) is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            out = self._pairs[left, right] = self.merged(self._symbols(left) + self._symbols(right)) == [left, right]
        return out


class Chunks:
    """What is known of white-space chunks (which no token crosses), put together from the pieces of the split.

    Chunks are learnt many at a time: one split of all of them, one call of the encoder for the pieces that are new. Caches
    are bounded and change nothing but the work.
    """

    GAP = b""

    def __init__(self, vocabulary: Vocabulary, keep: int = 400_000):
        self.v = vocabulary
        self.keep = keep
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn_pieces(self, new: list[str]) -> None:
        raise NotImplementedError

    def cut(self, chunks: list[str], pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def learn_odd(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > self.keep // 2:  # frequent chunks come over from the older half
            self.before, self.known = self.known, {"": b""}
        new = set().union(*texts).difference(self.known)  # asks for each new key; `- keys()` would walk all known ones
        again = new & self.before.keys()
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        plain, odd, fits = [], [], SIMPLE.fullmatch
        for c in new - again:
            (plain if fits(c) and "<|" not in c else odd).append(c)
        for at in range(0, len(plain), BATCH):
            part = plain[at : at + BATCH]
            pieces = PIECES_OF_LINES.findall("\n".join([*part, ""]).lower())
            if len(self.pieces) > self.keep:
                self.pieces = {}
            self.learn_pieces(list(set(pieces).difference(self.pieces) - {"\n"}))
            self.known.update(zip(part, self.cut(part, pieces)))
        self.known.update(zip(odd, self.learn_odd(odd)))

    def parts(self, texts: list[str | None], step: int = 256) -> Iterator[list[list[str]]]:
        """Chunks of each text, a few texts at a time, all of them known."""
        for at in range(0, len(texts), step):
            parts = [self.split(t or "") for t in texts[at : at + step]]
            self.learn(parts)
            yield parts

    def split(self, text: str) -> list[str]:
        return GAP.split(text)

    def batches(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """What is known of each text, a few texts at a time."""
        for parts in self.parts(texts):
            have = self.known.__getitem__
            yield [self.GAP.join(map(have, p)) for p in parts]


class ChunkIds(Chunks):
    """Token ids of texts as little-endian 32-bit words."""

    MARK = b"\xff" * 4  # no token's id; stands where a chunk ends

    def split(self, text: str) -> list[str]:
        return GAP.split(text) if ODD_SPACE.search(text) else text.split()

    def learn_pieces(self, new: list[str]) -> None:
        ids, ends = self.v.encoded(new) if new else (np.zeros(0, "<u4"), [])
        data, ends = ids.tobytes(), [4 * int(e) for e in ends]
        self.pieces.update(zip(new, [data[a:b] for a, b in zip([0, *ends], ends)]))
        self.pieces["\n"] = self.MARK

    def cut(self, chunks: list[str], pieces: list[str]) -> list[bytes]:
        data = b"".join(map(self.pieces.__getitem__, pieces))
        ends = (4 * np.flatnonzero(np.frombuffer(data, "<u4") == 0xFFFFFFFF)).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]

    def learn_odd(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.v.encoder.encode_batch_fast(chunks, add_special_tokens=False)]


class PrefixSteps(Chunks):
    """How much each character adds to the token count of the prefix that ends with it: a signed 16-bit word a character.

    The count at a prefix is the count at the end of the piece before it plus that of the beginning of its own piece. So the
    program runs over pieces, every distinct beginning of a piece is counted once, and sums of the steps are exact
    counts at every prefix. A step can be negative: a longer word may have fewer tokens.
    """

    GAP = b"\0\0"

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000):
        super().__init__(vocabulary, keep)

    def learn_pieces(self, new: list[str]) -> None:
        self.pieces["\n"] = b""
        short = sorted(p for p in new if len(p) < LONG and (p[0] != "'" or not p[1:2].isalpha()))
        self.pieces.update((p, self._by_itself(p)) for p in set(new) - set(short))
        if not short:
            return
        size = np.fromiter(map(len, short), np.int64, len(short))
        wide = int(size.max())
        letters = np.array(short, f"U{wide}").view("<u4").reshape(-1, wide)
        same = letters[1:] == letters[:-1]
        same &= letters[1:] != 0
        shared = np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(axis=1)])
        # in sorted order, a beginning is new where it is longer than what the piece shares with the one before
        ask = [p[:i] for p, k in zip(short, shared.tolist()) for i in range(k + 1, len(p) + 1)]
        place = np.arange(1, wide + 1)
        within = place <= size[:, None]
        own = (place > shared[:, None]) & within
        counts = np.zeros(own.shape, np.int64)
        counts[own] = np.diff(self.v.encoded(ask)[1], prepend=0)
        first = np.maximum.accumulate(np.where(own, np.arange(len(short))[:, None], 0), axis=0)
        steps = np.diff(np.take_along_axis(counts, first, axis=0), axis=1, prepend=0)
        data, ends = steps[within].astype("<i2").tobytes(), (2 * np.cumsum(size)).tolist()
        self.pieces.update(zip(short, [data[a:b] for a, b in zip([0, *ends], ends)]))

    def cut(self, chunks: list[str], pieces: list[str]) -> list[bytes]:
        data = b"".join(map(self.pieces.__getitem__, pieces))
        ends = (2 * np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def learn_odd(self, chunks: list[str]) -> list[bytes]:
        return [self._odd(c) for c in chunks]

    def _each(self, beginnings: list[str]) -> bytes:
        totals = [len(e.ids) for e in self.v.encoder.encode_batch_fast(beginnings, add_special_tokens=False)]
        return np.diff(totals, prepend=0).astype("<i2").tobytes()

    def _by_itself(self, piece: str) -> bytes:
        """A very long piece, or one whose beginnings split in another way."""
        if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():
            return self._each([piece[:i] for i in range(1, len(piece) + 1)])
        data = piece.encode("utf-8")
        kept = [c for c, after in zip(self._long(_letters(piece))[0], [*data[1:], 0]) if after & 0xC0 != 0x80]
        return np.diff(kept, prepend=0).astype("<i2").tobytes()

    def _next(self, states: dict[int, tuple[str, int]], letters: str, i: int) -> int:
        """The count of letters[:i] as a whole word; adds the state at i."""
        v, closed = self.v, 0
        for end in ("", END):
            for k in v.reach.get(letters[max(0, i - 2) : i] + end, ()) or v.reach[letters[i - 1 : i] + end]:
                if k <= i:
                    token, (left, count) = letters[i - k : i] + end, states[i - k]
                    if token in v.ids and (v.follows(left, token) if left else v.alone(token)):
                        break
            closed = count + 1
            if not end:
                states[i] = (token, closed)
        return closed

    def _long(self, letters: str, turns: dict[int, set[str]] | None = None) -> tuple[list[int], dict[tuple[int, str], int]]:
        """Counts of letters[:1], letters[:2], ... as whole words, and of letters[:k] + end for each k and end of turns.

        letters are byte-level characters. The encoding of each beginning ends in exactly one token that can follow the encoding
        of what is before it, so the count there is an earlier one plus one. Only the states within a token's length are kept.
        """
        states: dict[int, tuple[str, int]] = {0: ("", 0)}
        turns, wide, out, turned = turns or {}, self.v.longest, [], {}
        for i in range(1, len(letters) + 1):
            out.append(self._next(states, letters, i))
            states.pop(i - wide - 1, None)
            for end in turns.get(i, ()):
                low = max(0, i - wide - 2)
                near, own = letters[low:i] + end, {k - low: s for k, s in states.items() if k >= low}
                for k in range(i - low + 1, len(near) + 1):
                    turned[i, end] = self._next(own, near, k)
        return out, turned

    def _odd(self, chunk: str) -> bytes:
        """Parts between added tokens are counted by themselves; what is not yet a whole added token is text like any other."""
        counts, before, at = [], 0, 0
        for found in [*self.v.added.finditer(chunk), None]:
            own = self._normalised(chunk[at : found.end() if found else len(chunk)])
            if found:
                own[-1] = 1 + (own[found.start() - at - 1] if found.start() > at else 0)
                at = found.end()
            counts += [before + n for n in own]
            before = counts[-1] if counts else 0
        return np.diff(counts, prepend=0).astype("<i2").tobytes()

    def _normalised(self, text: str) -> list[int]:
        """Counts of text[:1], text[:2], ...

        The normal form of a beginning is that of the segments before (a segment starts at a character that never combines with what is
        before it) and that of a beginning of its last one. Where the latter begins the segment's own normal form, the count
        is one of the whole text's; else (an accent is still to come) the last piece takes a turn there.
        """
        normal, joins = self.v.encoder.normalizer.normalize_str, second_characters()
        starts = [i for i, c in enumerate(text) if not i or not (unicodedata.combining(c) or c in joins)]
        segments = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
        form = {s: normal(s) for s in set(segments)}
        whole = "".join(map(form.__getitem__, segments))
        # the library's own split of the whole
        found = [ab for _, ab in self.v.encoder.pre_tokenizer.pre_tokenize_str(whole)]
        self.learn_pieces(list({whole[a:b] for a, b in found}.difference(self.pieces)))
        steps, at = [], 0
        for a, b in found:
            steps += [b"\0\0" * (a - at), self.pieces[whole[a:b]]]
            at = b
        steps.append(b"\0\0" * (len(whole) - at))
        sums = [0, *np.cumsum(np.frombuffer(b"".join(steps), "<i2"), dtype=np.int64).tolist()]
        out: list[int] = []
        turns: list[tuple[int, int, str]] = []  # place in out, place in whole, what stands there instead
        begun: dict[str, list[str]] = {}
        k = 0
        for s in segments:
            if len(s) > 1:
                if s not in begun:
                    begun[s] = [normal(s[:i]) for i in range(1, len(s))]
                for n in begun[s]:
                    if form[s].startswith(n):
                        out.append(sums[k + len(n)])
                    else:
                        turns.append((len(out), k, n))
                        out.append(0)
            k += len(form[s])
            out.append(sums[k])
        if turns:
            self._turned(whole, found, sums, turns, out)
        return out

    def _turned(self, whole: str, found: list[tuple[int, int]], sums: list[int], turns: list[tuple[int, int, str]], out: list[int]) -> None:
        """out[place] = count of whole[:k] + other, for each (place, k, other) of turns."""
        split = lambda s: [s[a:b] for _, (a, b) in self.v.encoder.pre_tokenizer.pre_tokenize_str(s)]
        first = [a for a, _ in found]
        short: list[tuple[int, str]] = []
        long: dict[int, dict[int, set[str]]] = {}
        late: list[tuple[int, int, int, str]] = []
        for place, k, other in turns:
            a = first[bisect_left(first, k) - 1] if k else 0
            if k == 0 or k - a < LONG or whole[k - 1] == "'":
                out[place] = sums[a]
                short += [(place, p) for p in split(whole[a:k] + other)]
                continue
            head, *rest = split(whole[k - 1] + other)  # pieces are runs of one kind, so one character tells whether it goes on
            short += [(place, p) for p in rest]
            if len(head) == 1:
                out[place] = sums[k]
                continue
            end, at = _letters(head[1:]), len(whole[a:k].encode("utf-8"))
            out[place] = sums[a]
            long.setdefault(a, {}).setdefault(at, set()).add(end)
            late.append((place, a, at, end))
        ends = self.v.encoded([p for _, p in short])[1] if short else []
        for (place, _), n in zip(short, np.diff(ends, prepend=0).tolist()):
            out[place] += n
        stop = dict(found)
        turned = {a: self._long(_letters(whole[a : stop[a]]), at)[1] for a, at in long.items()}
        for place, a, at, end in late:
            out[place] += turned[a][at, end]

    def counts(self, text: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, ... characters."""
        return [0, *np.cumsum(np.frombuffer(next(self.batches([text]))[0], "<i2"), dtype=np.int64).tolist()]


_HELD: dict[str, object] = {}


def held(kind: type, path: str, keep: int | None = None):
    """One instance for each Python worker, which serves one task after another; its caches are bounded, by keep if given."""
    key = f"{kind.__name__}:{keep}:{path}"
    if key not in _HELD:
        vocabulary = _HELD.setdefault(f"vocabulary:{path}", Vocabulary(path))
        _HELD[key] = kind(vocabulary) if keep is None else kind(vocabulary, keep)
    return _HELD[key]


def prefix_table(steps: bytes) -> bytes:
    """The stored form of a text's steps: one byte a character where all fit into one, else two; compressed."""
    wide = np.frombuffer(steps, "<i2")
    narrow = wide.astype("i1")
    return zlib.compress(b"1" + narrow.tobytes() if (narrow == wide).all() else b"2" + steps, 1)


def read_table(table: bytes) -> np.ndarray:
    """Exact token counts of the prefixes of 0, 1, 2, ... characters."""
    data = zlib.decompress(table)
    steps = np.frombuffer(data, "i1" if data[:1] == b"1" else "<i2", offset=1)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def _longest(counts: np.ndarray, budget: int) -> int:
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_tables(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens, chars_within, prefix_table (binary); one row per row.

    prefix_table holds the exact token count of every prefix of the text, character by character: the library's count of
    text[:i], for each i. tokens_at and longest_within answer from it alone, without the text or the encoder; chars_within is
    longest_within's answer for budget, given at once.
    Null texts count as empty (0 tokens); ids may be null or repeated; equal texts give equal tables; a very long text costs a byte
    a character before compression; an empty table gives no rows; other columns are not read, whatever their names. path: the
    tokenizer file, at the same place on every executor. No shuffle.
    """

    @F.pandas_udf("n_tokens long, chars_within long, prefix_table binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for some in held(PrefixSteps, path).batches(texts.tolist()):
            for steps in some:
                counts = np.cumsum(np.frombuffer(b"\0\0" + steps, "<i2"), dtype=np.int64)
                out.append((int(counts[-1]), _longest(counts, budget), prefix_table(steps)))
        return pd.DataFrame(out, columns=["n_tokens", "chars_within", "prefix_table"])

    return df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        of(F.col(text_col)).alias("t"),
    ).select("id", "n_bytes", "t.*")


def tokens_at(table: Column, chars: Column) -> Column:
    """Tokens of the prefix of that many characters; null where it is longer than the text or negative."""

    @F.pandas_udf("long")
    def at(tables: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(tables, ends):
            counts = read_table(t)
            out.append(int(counts[n]) if 0 <= n < len(counts) else None)
        return pd.Series(out, dtype="Int64")

    return at(table, chars)


def longest_within(table: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most that many tokens."""

    @F.pandas_udf("long")
    def of(tables: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([_longest(read_table(t), most) for t, most in zip(tables, budgets)], dtype="int64")

    return of(table, budget)
