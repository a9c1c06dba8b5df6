"""Text that was decoded with a wrong character encoding: detection and restoring.

Characters are mapped back to the bytes of a legacy encoding, an automaton over those bytes finds maximal well-formed
multibyte spans (UTF-8, GBK), and only these spans are decoded. Where both encodings have one byte a character there is
no byte structure: the whole word is decoded instead. Every candidate competes with the text as it stands under a
character model (hashed trigrams of all non-ASCII words, counted over all rows) and a prior against shapes that no
writing has. Values with replacement characters can't be restored and are reported as such; so are words whose characters
became question marks, where an undamaged word elsewhere in the column has the other letters at the same places.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import uuid
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings a text may have been read with, and those it may have been written in.
READ_AS_SINGLE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp850", "cp437", "cp852", "cp1254", "mac-roman")
READ_AS_DOUBLE = ("gb18030", "big5", "shift_jis", "euc_kr")
WRITTEN_SINGLE = ("cp1252", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp866", "cp850", "iso8859-5", "mac-roman")
WRITTEN_DOUBLE = ("gb18030",)

UTF8_SPANS = re.compile(
    rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+"
)
#: As UTF8_SPANS with ASCII between, which may be the second byte of a double-byte character.
UTF8_TEXT = re.compile(rb"(?:[\x01-\x7F]|" + UTF8_SPANS.pattern + rb")+")
UTF8_CHARACTER = re.compile(rb"[\x01-\x7F]|[\xC2-\xF4][\x80-\xBF]+")
GBK_SPANS = re.compile(rb"(?:[\x81-\xFE][\x40-\x7E\x80-\xFE])+")
#: What a GBK span lies in: bytes that may belong to one, between those that never do.
GBK_RUNS = re.compile(rb"[\x40-\xFF]+")
#: Offsets and bits of the three tables of the character model (2^21, 2^18, 2^15 counters), whatever the size of the data.
TABLES = ((0, 21), (1 << 21, 18), ((1 << 21) + (1 << 18), 15))
MODEL_SIZE = sum(1 << bits for _, bits in TABLES)
#: A candidate must be this much more likely (natural logarithm) than the text as it stands.
MARGIN = 1.0
#: What well-formed UTF-8 in all of a word's foreign bytes counts for by itself.
STRUCTURE_BONUS = 1.5
#: What a transition that no writing has costs (natural logarithm).
ODD_COST = 3.0
#: How far below the best a partly scored candidate must be to be given up; terms above zero come from collisions only.
SLACK = 4.0
_LOST = re.compile("�")
_ASKED = re.compile(r"(?:^|(?<=[^\W\d_]))\?(?=[^\W\d_])")
#: Encodings that make question marks of the characters they don't have.
LOSSY = ("ascii", *READ_AS_SINGLE, "gb2312", "big5", "shift_jis", "euc_kr")
#: So many question marks behind the last word of a value are punctuation.
CLOSING_MARKS = 3
_EDGES = re.compile(r"^(?:[^\w?]|[\d_])+|(?:[^\w?]|[\d_])+$")
_SPLIT = re.compile(r"[ \t\n\r]+")


@lru_cache(maxsize=None)
def _table(encoding: str) -> dict[str, int]:
    """Characters of a one-byte encoding and their bytes; undefined bytes are read as the control of that number."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The legacy bytes of a text, NULs for characters that the encoding doesn't have; None if it has none of the non-ASCII ones."""
    if encoding in READ_AS_DOUBLE:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    table = _table(encoding)
    raw = bytes(table.get(c, 0) for c in text)
    return raw if max(raw, default=0) > 127 else None


def decode_spans(text: str, raw: bytes, spans: re.Pattern[bytes], encoding: str) -> tuple[str, int, int]:
    """The text with every maximal well-formed span of its bytes decoded; characters in spans, decoded characters."""
    out, at, covered, made = [], 0, 0, 0
    for m in spans.finditer(raw):
        part = m.group()
        try:
            good = part.decode(encoding)
        except UnicodeDecodeError:
            continue
        if any(c < " " or "\x7f" == c or unicodedata.category(c) in ("Cn", "Co") for c in good):
            continue  # C1 controls may be bytes of text that was garbled twice
        high = sum(b > 127 for b in part)
        if high == 0:
            continue
        out += [text[at : m.start()], good]
        at, covered, made = m.end(), covered + high, made + len(good)
    return "".join([*out, text[at:]]), covered, made


@lru_cache(maxsize=65536)
def _double(c: str, encoding: str) -> bytes:
    """The bytes of a character in a double-byte encoding, NUL if it has none."""
    try:
        return c.encode(encoding)
    except UnicodeEncodeError:
        return b"\0"


def _plausible(part: bytes, encoding: str) -> str | None:
    """The text of a span, None if it doesn't decode or holds what no text has."""
    try:
        good = part.decode(encoding)
    except UnicodeDecodeError:
        return None
    return None if any(c < " " or c == "\x7f" or unicodedata.category(c) in ("Cn", "Co") for c in good) else good


def segments(word: str, read: str, written: str) -> list[tuple[int, int, str]]:
    """Stretches of a word that are well-formed in another encoding: first and end character, decoded text.

    UTF-8 spans are cut where their characters and the word's characters both end, GBK spans count in runs that they cover.
    Characters that the encoding doesn't have end a span.
    """
    single = read not in READ_AS_DOUBLE
    parts = [bytes([_table(read).get(c, 0)]) for c in word] if single else [_double(c, read) for c in word]
    raw = b"".join(parts)
    spans: list[list[int]] = []
    if written == "utf-8":
        for m in UTF8_TEXT.finditer(raw):
            if m.group().isascii():
                continue
            spans.append([m.start(), *(m.start() + c.end() for c in UTF8_CHARACTER.finditer(m.group()))])
    else:
        for run in GBK_RUNS.finditer(raw):
            found = [(run.start() + m.start(), run.start() + m.end()) for m in GBK_SPANS.finditer(run.group())]
            if sum(b > 127 for a, e in found for b in raw[a:e]) == sum(b > 127 for b in run.group()) and all(_plausible(raw[a:e], written) for a, e in found):
                spans += [[a, e] for a, e in found]
    if not spans:
        return []
    place, at = {0: 0}, 0
    for i, part in enumerate(parts, 1):
        at += len(part)
        place[at] = i
    out = []
    for span in spans:
        cuts = [c for c in span if c in place]
        for a, e in zip(cuts, cuts[1:]):
            good = _plausible(raw[a:e], written)
            if good is not None and good != word[place[a] : place[e]]:
                out.append((place[a], place[e], good))
    return out


def replaced(word: str, parts: list[tuple[int, int, str]], model: Model | None = None) -> str:
    """The word with its segments decoded; with a model only those that are likelier so, behind what stands before them."""
    out, at = "", 0
    for first, end, good in parts:
        out += word[at:first]
        stands = word[first:end]
        if model is not None and model.likelihood(good, out) <= model.likelihood(stands, out):
            good = stands
        out, at = out + good, end
    return out + word[at:]


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """L, C, G, H: letter of a script; S symbol, P punctuation, N digit, X what no text has."""
    o = ord(c)
    if o < 128:
        return "L" if c.isalpha() else "N" if c.isdigit() else "X" if o < 32 or o == 127 else "P"
    category = unicodedata.category(c)
    if category[0] in "LM":
        if o in (0xAA, 0xB5, 0xBA):
            return "S"
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            return "L"
        if 0x400 <= o < 0x530:
            return "C"
        if 0x370 <= o < 0x400:
            return "G"
        if 0x2E80 <= o < 0xFB00 or 0x20000 <= o < 0x32000 or 0xFF00 <= o < 0xFFF0:
            return "H"
        return "O"
    if category in ("Cc", "Cn", "Co", "Cs"):
        return "X"
    if category[0] == "S" or category == "No":
        return "S"
    return "N" if category[0] == "N" else "P"


def oddness(word: str) -> int:
    """Transitions that no writing has: letters of two scripts side by side, a symbol or mark between two letters, a
    fraction after or a box before a letter, a small letter before a capital, control characters."""
    kinds = [_kind(c) for c in word]
    odd = kinds.count("X")
    for i in range(1, len(word)):
        a, b = kinds[i - 1], kinds[i]
        if a in "LCGHO" and b in "LCGHO":
            if a != b or (a in "LCG" and word[i - 1].islower() and word[i].isupper()):
                odd += 1
        elif 0x2500 <= ord(word[i - 1]) < 0x2600 and b in "LCGHO":
            odd += 1
        elif word[i] in "¼½¾" and a in "LCGHO":
            odd += 1
        elif word[i - 1] == "·" and b in "LCGHO" and (i < 2 or word[i - 2] not in "lL"):
            odd += 1
        elif b == "S" and a in "LCGHO" and i + 1 < len(word) and kinds[i + 1] in "LCGHOS":
            odd += 1
        elif b == "S" and a == "S" and ord(word[i]) > 127 and ord(word[i - 1]) > 127:
            odd += 1
    return odd


def grams(word: str) -> tuple[list[int], list[int], list[int]]:
    """Indices of a word's trigrams, bigrams and characters in the tables of the model."""
    (a3, b3), (a2, b2), (a1, b1) = TABLES
    codes = [2, 2, *map(ord, word), 3]
    m3, m2, m1 = (1 << b3) - 1, (1 << b2) - 1, (1 << b1) - 1
    one = [a1 + (c * 0x9E3779B1 >> 5 & m1) for c in codes]
    two = [a2 + ((x * 0x85EBCA6B + y * 0xC2B2AE35) >> 7 & m2) for x, y in zip(codes, codes[1:])]
    three = [a3 + ((x * 0x85EBCA6B + y * 0xC2B2AE35 + z * 0x27D4EB2F) >> 7 & m3) for x, y, z in zip(codes, codes[1:], codes[2:])]
    return three, two, one


class Model:
    """Counts of hashed character n-grams of all non-ASCII words."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.tolist()
        self.total = float(counts[TABLES[2][0] :].sum()) + 1.0

    def likelihood(self, part: str, before: str) -> float:
        """Score of a part of a word behind what stands before it, whatever follows."""
        left = before[-2:]
        three, two, one = grams(left + part)
        n, total, out = self.counts, self.total, 0.0
        for i in range(len(left), len(left) + len(part)):
            own = (n[one[i + 2]] + 0.2) / (total + 2000.0)
            pair = (n[two[i + 1]] + 2.0 * own) / (n[one[i + 1]] + 2.0)
            out += math.log((n[three[i]] + 2.0 * pair) / (n[two[i]] + 2.0))
        return out - ODD_COST * (oddness(left + part) - oddness(left))

    def score(self, word: str, floor: float = -math.inf) -> float:
        """Logarithm of a word's probability, less the cost of odd shapes. A word that falls SLACK below `floor` isn't scored
        to its end: what follows can't lift it again."""
        out, floor = 0.0, floor - SLACK
        (a3, b3), (a2, b2), (a1, b1) = TABLES
        m3, m2, m1 = (1 << b3) - 1, (1 << b2) - 1, (1 << b1) - 1
        n, total, log = self.counts, self.total + 2000.0, math.log
        x = y = 2
        one = n[a1 + (y * 0x9E3779B1 >> 5 & m1)]
        two = n[a2 + ((x * 0x85EBCA6B + y * 0xC2B2AE35) >> 7 & m2)]
        for z in (*map(ord, word), 3):
            next_one = n[a1 + (z * 0x9E3779B1 >> 5 & m1)]
            next_two = n[a2 + ((y * 0x85EBCA6B + z * 0xC2B2AE35) >> 7 & m2)]
            pair = (next_two + 2.0 * (next_one + 0.2) / total) / (one + 2.0)
            out += log((n[a3 + ((x * 0x85EBCA6B + y * 0xC2B2AE35 + z * 0x27D4EB2F) >> 7 & m3)] + 2.0 * pair) / (two + 2.0))
            if out < floor:
                return out
            x, y, one, two = y, z, next_one, next_two
        return out - ODD_COST * oddness(word)


def lost_before(word: str) -> bool:
    """Whether the word holds replacement characters that were written as UTF-8 and read as something else."""
    if "\u951f" in word:  # the first two of their three bytes, read as GBK
        return True
    return any(b"\xef\xbf\xbd" in raw for read in READ_AS_SINGLE if (raw := to_bytes(word, read)) is not None)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def core(word: str) -> str:
    """A word without the punctuation and digits around it; question marks stay."""
    return _EDGES.sub("", word)


def lossy_shapes(word: str) -> set[str]:
    """What an undamaged word looks like with question marks for characters, or for their UTF-8 bytes."""
    out = {word.encode(e, "replace").decode(e, "replace") for e in LOSSY}
    out.add("".join(c if c < "\x80" else "?" * len(c.encode("utf-8", "surrogatepass")) for c in word))
    return {x for x in out if "?" in x and x != word}


def asked_shape(word: str) -> tuple[str, str] | None:
    """The core of a word that may have lost characters as question marks, and what stands before those that end it."""
    shape = core(word)
    if "?" not in shape or shape == "?":
        return None
    stem = shape.rstrip("?")
    return shape, stem if stem and "?" not in stem and stem != shape else ""


def asked_parts(word: str) -> list[str]:
    """What stands before, between and behind question marks, where all of it has two or more letters."""
    parts = [core(p) for p in word.split("?")]
    return parts if all(len(p) > 1 for p in parts) else []


class Learned(NamedTuple):
    """What is counted over all rows: n-grams, and hashes of shapes with question marks that undamaged words have."""

    counts: np.ndarray
    lost: frozenset[int]
    stems: frozenset[int]  # what stands before closing question marks, or on both sides of one, and occurs by itself too


def candidates(word: str, model: Model | None = None) -> list[tuple[str, str, str, bool]]:
    """What a word may have been: (text, read as, written in, found by structure alone)."""
    out: dict[str, tuple[str, str, str, bool]] = {}
    high = sum(c > "\x7f" for c in word)

    def add(text: str, read: str, written: str, sure: bool) -> None:
        if text != word and "�" not in text and text not in out:
            out[text] = (text, read, written, sure)

    def add_segments(read: str, written: str) -> None:
        if parts := segments(word, read, written):
            add(replaced(word, parts), read, written, False)
            if model is not None and len(parts) > 1:
                add(replaced(word, parts, model), read, written, False)

    seen: set[bytes] = set()
    for read in READ_AS_SINGLE:
        raw = to_bytes(word, read)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        text, covered, made = decode_spans(word, raw, UTF8_SPANS, "utf-8")
        if covered:
            add(text, read, "utf-8", covered == high)
        for written in WRITTEN_DOUBLE:
            add_segments(read, written)
        if 0 in raw:
            continue
        for written in WRITTEN_SINGLE:
            if written != read:
                try:
                    add(raw.decode(written), read, written, False)
                except UnicodeDecodeError:
                    pass
    for read in READ_AS_DOUBLE:
        for written in ("utf-8", *WRITTEN_DOUBLE):
            if written != read:
                add_segments(read, written)
        raw = to_bytes(word, read)
        for written in WRITTEN_SINGLE[:5] if raw else ():
            try:
                add(raw.decode(written), read, written, False)
            except UnicodeDecodeError:
                pass
    return list(out.values())


class Detector:
    """Decides word by word; what it decided is kept, up to a bound."""

    def __init__(self, counts: np.ndarray, lost: frozenset[int] = frozenset(), stems: frozenset[int] = frozenset()) -> None:
        self.model, self.lost, self.stems = Model(counts), lost, stems
        self.words: dict[str, tuple[str, str] | None] = {}

    def word(self, word: str) -> tuple[str, str] | None:
        """(restored word, encodings) of a garbled word, None for others; an empty restored word: lost."""
        if word in self.words:
            return self.words[word]
        if len(self.words) > 200_000:
            self.words.clear()
        self.words[word] = found = self._decide(word)
        return found

    def _decide(self, word: str) -> tuple[str, str] | None:
        if _LOST.search(word):
            return "", "lost"
        if "?" in word and (asked := asked_shape(word)) is not None and _hash(asked[0]) in self.lost and not (asked[1] and _hash(asked[1]) in self.stems):
            return "", "lost"
        if word.isascii():
            return ("", "lost") if _ASKED.search(word) and not re.search(r"[/=&]", word) and not self._two_words(word) else None
        if lost_before(word):
            return "", "lost"
        mine = self.model.score(word)
        best = (mine + MARGIN, word, "")
        level, known = [(word, "")], {word}
        while level:  # text may have been garbled any number of times; each sure decoding has fewer characters
            deeper = []
            for now, how in level:
                for text, read, written, sure in candidates(now, self.model):
                    score, said = self.model.score(text, best[0] - STRUCTURE_BONUS * sure) + STRUCTURE_BONUS * sure, f"{how}, {written} as {read}" if how else f"{written} as {read}"
                    if score > best[0]:
                        best = (score, text, said)
                    if sure and text not in known:
                        known.add(text)
                        deeper.append((text, said))
            level = deeper
        return (best[1], best[2]) if best[2] else None

    def _two_words(self, word: str) -> bool:
        """Whether the question marks stand between words: all parts of two or more letters occur as words of their own."""
        parts = asked_parts(word)
        return len(parts) > 1 and all(_hash(p) in self.stems for p in parts)

    def value(self, text: str) -> tuple[str | None, str] | None:
        """(restored text or None, encodings) of a value that is garbled wholly or in part."""
        found: dict[str, tuple[str, str]] = {}
        words = _SPLIT.split(text.strip(" \t\n\r"))
        if len(words) > 1 and len(words[-1]) <= CLOSING_MARKS and not words[-1].strip("?"):
            words.pop()
        for w in words:
            if (not w.isascii() or "?" in w) and (f := self.word(w)):
                found[w] = f
        if not found:
            return None
        hows = sorted({h for _, h in found.values()})
        if "lost" in hows:
            return None, ", ".join(hows)
        return re.sub(r"[^ \t\n\r]+", lambda m: found[m.group()][0] if m.group() in found else m.group(), text), ", ".join(hows)


def _suspect(column: str):
    """What can be garbled at all: non-ASCII text, or a question mark inside a word."""
    c = F.col(column)
    return c.isNotNull() & ((F.octet_length(c) != F.char_length(c)) | c.contains("?"))


def train(values: DataFrame, column: str) -> Learned:
    """The character model and the shapes of lost words over all values, summed on the executors. To the driver come a table
    of fixed size, MODEL_SIZE counts, and of the distinct shapes with question marks those that undamaged words have."""

    def count(batches):
        import collections

        import pandas as pd

        table = np.zeros(MODEL_SIZE, dtype=np.int64)
        seen: collections.Counter[str] = collections.Counter()
        plain: set[str] = set()
        marks: dict[tuple[int, int], int] = {}  # (1 shape or 2 stem, hash): 1 in undamaged words, 2 asked

        def mark(kind: int, text: str, bit: int) -> None:
            at = (kind, _hash(text))
            marks[at] = marks.get(at, 0) | bit

        def flush():
            for word, n in seen.items():
                if not word.isascii():
                    for part in grams(word):
                        for i in part:
                            table[i] += n
                if "?" not in word:
                    bare = core(word)
                    mark(2, bare, 1)
                    for shape in lossy_shapes(bare):
                        mark(1, shape, 1)
                elif (asked := asked_shape(word)) is not None:
                    mark(1, asked[0], 2)
                    for part in (asked[1], *asked_parts(asked[0])):
                        if part:
                            mark(2, part, 2)
            seen.clear()
            for bare in {core(w) for w in plain}:
                if bare:
                    mark(2, bare, 1)
            plain.clear()

        def marked():
            return pd.DataFrame({"kind": [k for k, _ in marks], "at": [h for _, h in marks], "n": list(marks.values())})

        for batch in batches:
            for text in batch["t_"]:
                if text.isascii() and "?" not in text:
                    plain.update(text.split())
                    continue
                for w in _SPLIT.split(text):
                    if w.isascii() and "?" not in w:
                        plain.add(w)
                    elif "�" not in w:
                        seen[w] += 1
            if len(seen) + len(plain) > 100_000:
                flush()
            if len(marks) > 1_000_000:
                yield marked()
                marks.clear()
        flush()
        at = np.flatnonzero(table)
        if len(at):
            yield pd.DataFrame({"kind": 0, "at": at.astype("int64"), "n": table[at]})
        if marks:
            yield marked()

    parts = values.where(F.col(column).isNotNull()).select(F.col(column).alias("t_")).mapInPandas(count, "kind int, at bigint, n bigint")
    both = parts.groupBy("kind", "at").agg(F.sum("n").alias("n"), F.bit_or("n").alias("bits"))
    rows = both.where((F.col("kind") == 0) | (F.col("bits") == 3)).toPandas()
    counts = np.zeros(MODEL_SIZE, dtype=np.int64)
    grammed = rows[rows["kind"] == 0]
    counts[grammed["at"].to_numpy()] = grammed["n"].to_numpy()
    return Learned(counts, *(frozenset(rows.loc[rows["kind"] == k, "at"].tolist()) for k in (1, 2)))


_DETECTORS: dict[str, Detector] = {}


def garbled(rows: DataFrame, key: str, column: str, learned: Learned | None = None) -> DataFrame:
    """Rows whose text was read in a wrong encoding, wholly or in part: key, text, restored (NULL: lost), encodings.

    The model is counted over all values of the same table unless given. NULL and empty texts are never garbled, repeated
    rows count each, very long texts are judged word by word like others.
    """
    spark = rows.sparkSession
    learned = train(rows, column) if learned is None else learned
    small = np.minimum(learned.counts, 2**31 - 1).astype(np.int32)
    model = spark.sparkContext.broadcast((small, learned.lost, learned.stems))  # 9.6 MB of counts at any size of the data
    kind = rows.schema[key].dataType.simpleString()
    ident = uuid.uuid4().hex  # a reused worker must not judge by the model of another call

    def judge(batches):
        import pandas as pd

        if ident not in _DETECTORS:
            _DETECTORS.clear()
            _DETECTORS[ident] = Detector(*model.value)
        judged = _DETECTORS[ident]
        for batch in batches:
            keys, texts, fixed, hows = [], [], [], []
            for k, t in zip(batch["k_"], batch["t_"]):
                if (f := judged.value(t)) is not None:
                    keys.append(k)
                    texts.append(t)
                    fixed.append(f[0])
                    hows.append(f[1])
            if keys:
                yield pd.DataFrame({"key": keys, "text": texts, "restored": fixed, "encodings": hows})

    asked = rows.where(_suspect(column)).select(F.col(key).alias("k_"), F.col(column).alias("t_"))
    return asked.mapInPandas(judge, f"key {kind}, text string, restored string, encodings string").withColumnRenamed("key", key)
