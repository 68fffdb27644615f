"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a block of texts go into a trie. A depth-first walk keeps, for the prefix at each node, the last
token of its encoding. Two facts make that enough. The encoding of a prefix that ends at a token boundary is the
matching prefix of the encoding. A sequence of tokens is an encoding just if each neighbouring pair is the encoding of
its own letters. So the last token of a prefix is the one suffix token whose pair with the last token of what stands
before it encodes to itself, and a prefix that many words share is worked out once. Words carry an end mark on the last
letter, so a word's end is a leaf of its own below its last prefix.

Null and empty texts have no tokens. Special tokens in a text keep their own ids. Rows are independent of each other, so
repeated rows give repeated results and an empty table an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts, worker_cache
from .words import WORD_END, Vocabulary, byte_letters

_LETTERS = byte_letters()
#: Distinct words in one of the two generations that a worker keeps encoded, so that memory is bounded.
KEPT_WORDS = 400_000


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.made_of = {a + b: (a, b) for a, b in vocabulary.ranks}
        for pair, rank in vocabulary.ranks.items():
            if any(vocabulary.ranks[self.made_of[x]] >= rank for x in pair if x in self.made_of):
                raise ValueError(f"a merge comes before its parts: {pair}")
        self.inner = {t: t for t in vocabulary.ids if not t.endswith(WORD_END) or t == WORD_END}
        self.final = {t[: -len(WORD_END)]: t for t in vocabulary.ids if t.endswith(WORD_END) and t != WORD_END}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.edges: tuple[dict, dict] = {}, {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the merge of lowest rank first, the leftmost of equals. Asked once for each token alone."""
        ranks = self.v.ranks
        while len(symbols) > 1:
            rank, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def stands_alone(self, token: str) -> bool:
        known = self.alone.get(token)
        if known is None:
            stem = token[: -len(WORD_END)] if token.endswith(WORD_END) and token != WORD_END else None
            letters = list(token) if stem is None else [*stem[:-1], stem[-1] + WORD_END]
            known = self.alone[token] = self.merged(letters) == [token]
        return known

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The symbols that are this token's last (side 1) or first (side 0) one while it is merged, each with the rank
        of the merge that ends it."""
        own = self.edges[side].get(token)
        if own is None:
            own, symbol, until = [], token, float("inf")
            while symbol in self.made_of:
                own.append((symbol, until))
                until = self.v.ranks[self.made_of[symbol]]
                symbol = self.made_of[symbol][side]
            own.append((symbol, until))
            self.edges[side][token] = own
        return own

    def compatible(self, a: str, b: str) -> bool:
        """Whether the letters of a and b encode to [a, b]: no merge across them has its turn while both its parts are
        at the border. At equal ranks the left merge goes first."""
        ranks = self.v.ranks
        for x, x_until in self.edge(a, 1):
            for y, y_until in self.edge(b, 0):
                rank = ranks.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def encode_words(self, words) -> dict[str, list[str]]:
        """The tokens of each distinct word. Sorted words are the trie's depth-first order: what two neighbours share
        is on the path already, and only the rest of the second one's path is walked. lasts[i] is the last token of the
        encoding of the path's first i letters."""
        out: dict[str, list[str]] = {}
        spelled = sorted(("".join([_LETTERS[b] for b in w.encode("utf-8")]), w) for w in set(words))
        pair_ok, longest, mark = self.pair_ok, self.longest, len(WORD_END)
        path, lasts = "", [None]
        for text, word in spelled:
            n = len(text)
            shared, most = 0, min(len(path), n - 1)
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del lasts[shared + 1 :]
            for i in range(shared + 1, n + 1):
                tokens = self.inner if i < n else self.final
                for start in range(i - longest if i > longest else 0, i):
                    token = tokens.get(text[start:i])
                    if token is None:
                        continue
                    key = (lasts[start], token)
                    ok = pair_ok.get(key)
                    if ok is None:
                        ok = self.stands_alone(token) and (start == 0 or self.compatible(*key))
                        pair_ok[key] = ok
                    if ok:
                        break
                else:
                    raise ValueError(f"no encoding of {text!r}")
                lasts.append(token)
            path = text[:-1]
            spelt, at = [token], n - len(token) + mark
            lasts.pop()
            while at:
                token = lasts[at]
                spelt.append(token)
                at -= len(token)
            spelt.reverse()
            out[word] = spelt
        if len(pair_ok) > 1_000_000:
            pair_ok.clear()
        return out


class CachedEncoder:
    """Words to finished values (made by `finish` from a word's tokens), through the trie for words not yet seen."""

    def __init__(self, path: str, finish, kept: int = KEPT_WORDS):
        self.v = Vocabulary(path)
        self.trie, self.finish, self.kept, self.known, self.older = TrieEncoder(self.v), finish, kept, {}, {}

    def learn(self, lists: list[list[str]]) -> None:
        """Two generations: when the younger one is full it becomes the older one, from which words in use return."""
        if len(self.known) > self.kept:
            self.known, self.older = {}, self.known
        new = set().union(*lists) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        if new := new - again:
            finish = self.finish
            self.known.update([(w, finish(t)) for w, t in self.trie.encode_words(new).items()])

    def encode_all(self, block: list[str]) -> list[list]:
        """The finished values of each text, in order; a special token counts as a word of its own."""
        parts = [self.v.pieces(t) for t in block]
        lists = [[(() if s else self.v.words(p), s, p) for p, s in own] for own in parts]
        self.learn([w for own in lists for w, s, _ in own if not s])
        known, out = self.known, []
        for own in lists:
            values = []
            for w, s, p in own:
                values += [self.finish([p])] if s else list(map(known.__getitem__, w))
            out.append(values)
        return out


def _as_array(v: Vocabulary, tokens: list[str]) -> np.ndarray:
    return np.array([v.number[t] for t in tokens], np.int32)


def _as_written(v: Vocabulary, tokens: list[str]) -> tuple[int, str, str]:
    return len(tokens), " ".join([str(v.number[t]) for t in tokens]), " ".join(tokens)


def cached_encoder(path: str, use: str, finish) -> CachedEncoder:
    """One encoder a worker process, so that a worker's later tasks know its earlier words. `finish` takes the vocabulary
    and a word's tokens."""

    def make():
        e = CachedEncoder(path, None)
        e.finish = lambda tokens: finish(e.v, tokens)
        return e

    return worker_cache(f"bpe {use} {path}", make)


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the whole text's token ids."""

    def work(batches):
        enc = cached_encoder(tokenizer_path, "ids", _as_array)
        for b in small_batches(batches):
            values = enc.encode_all([t or "" for t in b.column("text").to_pylist()])
            flat = [np.concatenate(v) if v else np.empty(0, np.int32) for v in values]
            ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, decoded: tokens joined by a space, as a tokenizer without a decoder of its own gives them."""

    def work(batches):
        names = Vocabulary(tokenizer_path).names
        for b in batches:
            said = [" ".join([names[i] for i in ids]) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(said, pa.string())], ["doc_id", "decoded"])

    return encoded.mapInArrow(work, "doc_id long, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass, without the lists leaving the worker.

    Ids and decoded tokens are written once for each distinct word, and joined for each text."""

    def work(batches):
        enc = cached_encoder(tokenizer_path, "written", _as_written)
        for b in small_batches(batches):
            counts, said, decoded = [], [], []
            for values in enc.encode_all([t or "" for t in b.column("text").to_pylist()]):
                n, a, d = zip(*values, strict=True) if values else ((), (), ())
                counts.append(sum(n))
                said.append(hashlib.sha256(" ".join(a).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join(d).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe_trie(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())


QUERIES = {"op6_bpe_trie": op6_bpe_trie}
ORACLES: dict[str, str] = {}
