"""Token ids of a corpus by a public tokenizer: shared chunks are encoded once, their joins repaired until exact."""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.plans.lineage import materialize
from pagewright.plans.skew import skew_join

#: Folder of the tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("PAGEWRIGHT_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pattern that splits text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the rolling hash, and limits of a chunk's length: a chunk ends where MASK bits of the hash are zero.
WINDOW, LEAST, MASK, MOST = 24, 128, (1 << 9) - 1, 4096
#: How far the pattern looks beyond a piece: a split this far from a chunk's end doesn't depend on what follows.
REACH = 3


class Encoder:
    """A byte-pair tokenizer with its splits; loaded once in each Python worker."""

    def __init__(self, name: str, folder: str) -> None:
        import regex
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokenizer = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_ordinary(text)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of the split; short ones are remembered, up to a bound."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.tokenizer.encode_ordinary(piece)
            if len(piece) < 40:
                if len(self.pieces) > 200_000:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def chunk(self, text: str) -> tuple[list[int], int, int]:
        """Ids of a chunk by itself, and its last split that nothing behind the chunk can change (character, token)."""
        ids = self.encode(text)
        safe = 0
        for m in self.pattern.finditer(text):
            if m.start() + REACH > len(text):
                break
            safe = m.start()
        token = self.token_at(ids, text, safe)
        return (ids, 0, 0) if token is None else (ids, safe, token)

    def token_at(self, ids: list[int], text: str, at: int) -> int | None:
        """Index of the token that begins at a character; None if none does."""
        byte = at if text.isascii() else len(text[:at].encode("utf-8"))
        ends = np.cumsum(self.lengths[ids])
        token = int(np.searchsorted(ends, byte, "left")) + 1 if byte else 0
        return token if not byte or (token <= len(ids) and ends[token - 1] == byte) else None

    def join(self, chunks) -> list[int]:
        """The ids of a text from its chunks (ids, tail character, tail token), in order.

        `rest` is what stands after the last exact split. It is encoded anew together with the beginning of the next
        chunk until one of its splits is one of that chunk's own; from there on the chunk's ids hold. Where none is met
        the whole chunk joins the rest. A chunk's text is that of its ids, so it needn't travel with them.
        """
        out: list[int] = []
        rest = ""
        for ids, tail, tail_token in chunks:
            text = self.tokenizer.decode(ids)
            if not rest:
                out += ids[:tail_token]
                rest = text[tail:]
                continue
            met, pieces = None, []
            for width in (64, 400, len(text)):
                head = text[:width]
                own = {m.start() for m in self.pattern.finditer(head) if m.start() + REACH <= len(head) and m.start() <= tail}
                window, pieces = rest + head, []
                for m in self.pattern.finditer(window):
                    at = m.start() - len(rest)
                    if at >= 0 and at in own and m.start() + REACH <= len(window) and (token := self.token_at(ids, text, at)) is not None:
                        met = (at, token)
                        break
                    pieces.append(m.group())
                if met or width >= len(text):
                    break
            if met is None:
                rest += text
                continue
            for piece in pieces:
                out += self.encode_piece(piece)
            out += ids[met[1] : tail_token]
            rest = text[tail:]
        for m in self.pattern.finditer(rest):
            out += self.encode_piece(m.group())
        return out


@lru_cache(maxsize=4)
def encoder(name: str, folder: str) -> Encoder:
    return Encoder(name, folder)


def cut_points(texts: list[str]) -> list[list[int]]:
    """Where each text is cut into chunks, by a hash of the WINDOW characters before; the same passage is cut alike in
    every text, from LEAST characters after the last cut on."""
    sizes = [len(t) for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = (codes + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(len(codes), dtype=np.uint64)
    factor = np.uint64(1)
    for j in range(WINDOW):
        if j < len(codes):
            rolled[j:] += mixed[: len(codes) - j] * factor
        factor = np.uint64((int(factor) * 0xD6E8FEB86659FD93) % 2**64)
    marks = np.flatnonzero(((rolled >> np.uint64(20)) & np.uint64(MASK)) == 0) + 1
    out, base = [], 0
    for n in sizes:
        mine = marks[np.searchsorted(marks, base + LEAST) : np.searchsorted(marks, base + n, "right")] - base
        cuts, last = [], 0
        for m in mine.tolist():
            while m - last > MOST:
                last += MOST
                cuts.append(last)
            if m - last >= LEAST and n - m > 0:
                cuts.append(m)
                last = m
        while n - last > MOST:
            last += MOST
            cuts.append(last)
        out.append(cuts)
        base += n
    return out


def token_ids(documents: DataFrame, key: str = "doc_id", column: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Token ids of every text without special tokens: key, ids.

    NULL and empty texts give an empty list; strings that look like special tokens are ordinary text. Texts are cut into
    content-defined chunks, each distinct chunk is encoded once, and the ids of a text are put together from its chunks
    with their joins encoded anew, equal to the encoding of the whole text. Rows with a repeated key count each.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("k_"), F.col(column).alias("t_"), F.monotonically_increasing_id().alias("row_"))

    def cut(batches):
        import pandas as pd

        for batch in batches:
            texts = batch["t_"].tolist()
            out_k, out_r, out_s, out_n, out_h, out_t = [], [], [], [], [], []
            for k, r, t, cuts in zip(batch["k_"], batch["row_"], texts, cut_points(texts)):
                at = 0
                for s, to in enumerate([*cuts, len(t)]):
                    piece = t[at:to]
                    at = to
                    out_k.append(k)
                    out_r.append(r)
                    out_s.append(s)
                    out_n.append(len(cuts) + 1)
                    out_t.append(piece)
                    out_h.append(hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pd.DataFrame({"k_": out_k, "row_": out_r, "seq": out_s, "n": out_n, "h": out_h, "piece": out_t})

    def encode(batches):
        import pandas as pd

        enc = encoder(tokenizer, folder)
        for batch in batches:
            made = [enc.chunk(t) for t in batch["piece"]]
            frame = pd.DataFrame(made, columns=["ids", "tail", "tail_token"])
            yield pd.concat([batch[["h"]].reset_index(drop=True), frame], axis=1)

    def mend(batches):
        import pandas as pd

        enc = encoder(tokenizer, folder)
        for batch in batches:
            ids = [enc.join([(p["ids"].tolist(), p["tail"], p["tail_token"]) for p in parts]) for parts in batch["parts"]]
            yield pd.DataFrame({"k_": batch["k_"], "ids": ids})

    has_text = F.length("t_") > 0
    pieces = materialize(rows.where(has_text).mapInPandas(cut, f"k_ {kind}, row_ bigint, seq int, n int, h binary, piece string"))
    distinct = pieces.groupBy("h").agg(F.any_value("piece").alias("piece"))
    coded = distinct.mapInPandas(encode, "h binary, ids array<int>, tail int, tail_token int")
    placed = skew_join(pieces.select("k_", "row_", "seq", "n", "h"), coded, ["h"])
    placed = materialize(placed.drop("h"))
    single = placed.where("n = 1").select("k_", "ids")
    several = placed.where("n > 1").groupBy("k_", "row_").agg(F.sort_array(F.collect_list(F.struct("seq", "ids", "tail", "tail_token"))).alias("parts"))  # the chunks of one text
    done = single.unionByName(several.select("k_", "parts").mapInPandas(mend, f"k_ {kind}, ids array<int>"))
    none = rows.where(~F.coalesce(has_text, F.lit(False))).select("k_", F.array().cast(T.ArrayType(T.IntegerType())).alias("ids"))
    return done.unionByName(none).withColumnRenamed("k_", key)


def token_counts(documents: DataFrame, key: str, column: str, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """Number of tokens of every text that has any: key, n_tokens."""
    kind = documents.schema[key].dataType.simpleString()

    def count(batches):
        import pandas as pd

        enc = encoder(tokenizer, folder)
        for batch in batches:
            yield pd.DataFrame({"k_": batch["k_"], "n_tokens": [len(enc.encode(t)) for t in batch["t_"]]})

    rows = documents.where(F.length(column) > 0).select(F.col(key).alias("k_"), F.col(column).alias("t_"))
    return rows.mapInPandas(count, f"k_ {kind}, n_tokens bigint").withColumnRenamed("k_", key)
