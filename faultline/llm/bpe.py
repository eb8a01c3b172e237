"""BPE encoding and decoding by depth-first traversal of a trie of words.

The BPE encoding of a prefix ends in one last token, and what is left before
that token is again the encoding of a prefix. So a prefix's state is its last
token alone, and it follows from the states of shorter prefixes: of the tokens
that end the prefix, exactly one forms a pair with the last token before it that
the merges would leave apart. The distinct new words of a block form a trie, held as
its words in order (its depth-first order). The walk keeps the last tokens of the
path, so a prefix that words share is encoded once, and a word is read off at its end.

Tokens are spelled in symbols: a byte's letter, and another symbol for a letter
that ends a word. Normalizing and splitting words are the library's. Tasks hold
no more than a block's words, one trie and a bounded memory of known words;
nothing is shuffled and a task that runs again gives the same rows.

Defined results: a null or empty text has no tokens and decodes to an empty text.
Repeated rows are encoded each. Special tokens written in a text are that token,
as in the library. Words beyond ``LONG`` letters are not remembered. An empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import blocks, text_bytes
from faultline.llm.packing import byte_letters

#: Bytes of text whose words are looked at together; what stands between white space, words, and pairs of tokens that a worker remembers.
BLOCK, KNOWN, WORDS, PAIRS = 4 << 20, 250_000, 400_000, 250_000
#: Letters of the longest word that is remembered.
LONG = 256
#: Marks that may follow a plain word of Latin letters.
MARKS = ".,!?;:"
LATIN = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{MARKS}]*)")
#: A letter that ends a word is the symbol this far above it.
ENDS = 0x1000


class Merges:
    """The merges of a vocabulary, and which neighbours they leave apart."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.size = max(vocab.values(), default=0) + 1
        self.rank, self.left, self.right = [-1] * self.size, [0] * self.size, [0] * self.size
        spelled: list[str | None] = [None] * self.size
        made = {a + b for a, b in merges}
        for token, i in vocab.items():
            if token not in made:
                body = token.removesuffix(suffix) if suffix and len(token) > len(suffix) else token
                spelled[i] = body if body == token else body[:-1] + chr(ord(body[-1]) + ENDS)
                if len(body) != 1:
                    raise ValueError(f"no merge makes the token {token!r}")
        self.together: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if spelled[x] is None or spelled[y] is None or self.rank[t] >= 0:
                raise ValueError("a merge comes before its parts, or two merges make one token")
            spelled[t], self.rank[t], self.left[t], self.right[t] = spelled[x] + spelled[y], r, x, y
            self.together[x * self.size + y] = r
        self.pairs: dict[int, bool] = {}
        whole = [r < 0 for r in self.rank]
        for a, b in merges:
            t, x, y = vocab[a + b], vocab[a], vocab[b]
            whole[t] = whole[x] and whole[y] and self._apart(x, y, 3 * self.rank[t] + 1)
        #: Tokens that their own spelling is encoded to, by spelling.
        self.token = {s: i for i, s in enumerate(spelled) if s is not None and whole[i]}
        self.length = [len(s or "") for s in spelled]
        self._suffixes()

    def _suffixes(self) -> None:
        """An automaton over the tokens' spellings: ``longest[state]`` is the longest token
        that ends what was read, ``shorter[t]`` the next shorter one that ends t."""
        self.go: list[dict[str, int]] = [{}]
        self.longest, self.fall, self.shorter = [-1], [0], [-1] * self.size
        for spelling, t in self.token.items():
            state = 0
            for s in spelling:
                below = self.go[state].get(s)
                if below is None:
                    below = self.go[state][s] = len(self.go)
                    self.go.append({})
                    self.longest.append(-1)
                    self.fall.append(0)
                state = below
            self.longest[state] = t
        level = list(self.go[0].values())
        while level:
            deeper = []
            for state in level:
                back = self.longest[self.fall[state]]
                if self.longest[state] < 0:
                    self.longest[state] = back
                else:
                    self.shorter[self.longest[state]] = back
                for s, below in self.go[state].items():
                    self.fall[below] = self.step(self.fall[state], s)
                    deeper.append(below)
            level = deeper

    def step(self, state: int, s: str) -> int:
        go = self.go
        while True:
            after = go[state].get(s)
            if after is not None:
                return after
            if not state:
                return 0
            state = self.fall[state]

    def _apart(self, u: int, v: int, limit: float = float("inf")) -> bool:
        """Whether no merge joins the end of u to the start of v before ``limit``.
        Looks back in time: the later one of the merges that made u and v is undone,
        and a merge of the two parts that touch counts if it came before that. At
        one rank the merge further left comes first."""
        rank, size, together = self.rank, self.size, self.together
        while True:
            r = together.get(u * size + v)
            if r is not None and 3 * r + 1 < limit:
                return False
            before, after = 3 * rank[u], 3 * rank[v] + 2
            if before < 0 and after < 0:
                return True
            if before > after:
                limit, u = before, self.right[u]
            else:
                limit, v = after, self.left[v]

    def apart(self, u: int, v: int) -> bool:
        key = u * self.size + v
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(u, v)
        return known

    def encode(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """The tokens of distinct words of symbols, in order of the words: the trie in its
        depth-first order. A word keeps of the path before it the prefix that both share,
        with the last tokens and the states of the automaton, and goes on from there."""
        go, step, longest, shorter = self.go, self.step, self.longest, self.shorter
        length, size, pairs, apart = self.length, self.size, self.pairs, self.apart
        lasts, states, before = [0], [0], ""
        for word in words:
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del lasts[shared + 1:], states[shared + 1:]
            depth, state, before = shared, states[shared], word
            for s in word[shared:] if shared else word:
                depth += 1
                after = go[state].get(s)
                state = step(state, s) if after is None else after
                t = longest[state]
                while t >= 0:  # the one that the last token before it leaves apart
                    n = length[t]
                    if n == depth:
                        break
                    u = lasts[depth - n]
                    free = pairs.get(u * size + t)
                    if free or (free is None and apart(u, t)):
                        break
                    t = shorter[t]
                else:
                    raise ValueError(f"the vocabulary has no token for {s!r}")
                lasts.append(t)
                states.append(state)
            out = []
            while depth:  # back from the word's end
                t = lasts[depth]
                out.append(t)
                depth -= length[t]
            out.reverse()
            yield word, out


class Vocabulary:
    """A vocabulary file of the tokenizers library: byte-level BPE with a word end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.suffix or any(model.get(x) for x in (
                "dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or self.split(" a \t b\n") != ["a", "b"]:
            raise ValueError("only byte-level BPE with a word end and without white space")
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merges = Merges(model["vocab"], merges, self.suffix)
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {k: special[k] for k in sorted(special, key=len, reverse=True)}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Ids by what stands between white space, and by word of byte letters.
        self.known: dict[bytes, bytes] = {}
        self.heads = self._special_ids()
        # Plain words skip the library if it treats all their letters and marks as expected.
        self.letters = byte_letters()
        alphabet = "".join(c for c in map(chr, range(65, 256)) if LATIN.fullmatch(c))
        probes = [alphabet, *alphabet, *(f"{a}{b}" for a in "aZéÉ" for b in "." + MARKS), *(f"a{x}{y}" for x in MARKS for y in MARKS)]
        self.plain = all(self._plain(w) == self.split(w) for w in probes)

    def _special_ids(self) -> dict[str, bytes]:
        return {k: self.packed[i] for k, i in self.special.items()}

    def _plain(self, word: str) -> list[str] | None:
        """Latin letters and the marks after them, without the library."""
        found = LATIN.fullmatch(word)
        if found is None:
            return None
        head, tail = found.groups()
        head = head.lower()
        if not head.isascii():
            head = "".join(map(self.letters.__getitem__, head.encode()))
        return [head, tail] if tail else [head]

    def split(self, word: str) -> list[str]:
        """The words of byte letters that the library's normalizer and splitter make."""
        if self.tokenizer.normalizer is not None:
            word = self.tokenizer.normalizer.normalize_str(word)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]

    def parts(self, word: str) -> list[str]:
        """Words of byte letters, and special tokens as they are written."""
        if self.plain and (found := self._plain(word)):
            return found
        if self.marks is None or not self.marks.search(word):
            return self.split(word)
        return [p for i, x in enumerate(self.marks.split(word)) for p in ([x] if i % 2 else self.split(x))]

    def learn(self, words: set[bytes]) -> None:
        """Encode what stands between white space and is not known yet. The normalizer
        and the splitter never look past ASCII white space."""
        if len(self.known) > KNOWN:
            self.known = {}
        if len(self.heads) > WORDS:
            self.heads = self._special_ids()
        new = [w for w in words if w not in self.known]
        parts = [self.parts(w.decode()) for w in new]
        heads = self.heads
        symbols = {p[:-1] + chr(ord(p[-1]) + ENDS): p for x in parts for p in x if p not in heads}
        for s, ids in self.merges.encode(sorted(symbols)):
            heads[symbols[s]] = b"".join(map(self.packed.__getitem__, ids))
        for w, x in zip(new, parts):
            self.known[w] = heads[x[0]] if len(x) == 1 else b"".join([heads[p] for p in x])
        for p in [p for p in symbols.values() if len(p) > LONG]:
            del heads[p]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for w in [w for w in self.known if len(w) > LONG]:
            del self.known[w]
        return out


class Names:
    """The tokens' names by id, as the library decodes them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        names = tokenizer.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.decoder = tokenizer.decoder

    def decode(self, ids: bytes) -> str:
        words = map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return " ".join(words) if self.decoder is None else self.decoder.decode(list(words))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def names(path: str) -> Names:
    return Names(path)


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """All columns but the text, with ``n_tokens`` long and ``ids`` binary (unsigned
    32-bit integers, the lowest byte first) at the end, and what ``decode`` makes of them
    if ``decoded``. ``path`` names the vocabulary file on every executor. Columns of
    these names are replaced."""
    added = ["n_tokens", "ids", "decoded"][:3 if decoded else 2]
    others = [c for c in docs.columns if c.lower() not in (text.lower(), *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            offsets, raw = text_bytes(batch.column("__text"))
            data = raw.tobytes()
            for first, last in blocks(offsets, BLOCK):
                ids = v.encode([data[offsets[i]: offsets[i + 1]] for i in range(first, last)])
                out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    out.append(pa.array(map(names(path).decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("__row").slice(first, last - first), *out], names=["__row", *added])

    packed = docs.select(_row(others), F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    schema = T.StructType([packed.schema["__row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("decoded", T.StringType())][:1 + len(added)])
    return packed.mapInArrow(run, schema).select(*[F.col(f"__row.`{c}`") for c in others], *added)


def decode(table: DataFrame, path: str) -> DataFrame:
    """The columns of the table with ``ids`` replaced by ``decoded`` string, as the
    library decodes without skipping special tokens. Null ids decode to null."""
    others = [c for c in table.columns if c.lower() not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names(path)
        for batch in batches:
            texts = [None if x is None else known.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], names=["__row", "decoded"])

    packed = table.select(_row(others), "ids")
    schema = T.StructType([packed.schema["__row"], T.StructField("decoded", T.StringType())])
    return packed.mapInArrow(run, schema).select(*[F.col(f"__row.`{c}`") for c in others], "decoded")


def _row(names: list[str]) -> Column:
    """One column for all others: Arrow functions take no names with dots."""
    return F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in names]).alias("__row")
