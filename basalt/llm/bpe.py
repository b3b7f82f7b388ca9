"""BPE encoding and decoding by traversing the prefix trie of the distinct words.

A text is cut into words by the byte-level pattern; every Arrow batch encodes each distinct word once.
The sorted distinct words are a trie in depth-first order: neighbours share a path as long as their common
prefix, and what is known along the path stays on a stack. The state of a trie node is the last token of
its prefix's encoding. A token t that ends at the node is that last token exactly when it is compatible with the
last token u at the node where t begins, that is when byte pair encoding leaves u and t apart. Exactly one
token is, so a shared prefix is encoded once, and a word's encoding is read back along the states.

u and t stay apart unless a merge crosses between them first: some piece on the right edge of u with some
piece on the left edge of t, at a rank before either is merged into something larger.

Vocabularies are read by the driver, checked for size, and broadcast. Row by row: no shuffle. Memory: one
Arrow batch, its distinct words, and a bounded cache of words.

Defined results: a null text is the empty text and gives no ids; special tokens that stand in a text are their
ids, as in the library; repeated rows give repeated results; an empty table gives an empty table; extra columns
are ignored; ids that the vocabulary lacks are an error in `decode`.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import HELD, as_texts, pick, sliced, table

#: Fixed pattern of the byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the installed pattern engine takes as letters or numbers since Unicode 17, and the library does not.
LATER = (
    r"\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf\U0000a7d2\U0000a7d4"
    r"\U0000a7dd\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
)
MOST_VOCAB_BYTES = 64 << 20
#: A worker holds at most about so many words and pairs between batches.
CACHED_WORDS, CACHED_PAIRS = 300_000, 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself where it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of each id, special tokens included."""
    alphabet = byte_alphabet()
    plain = {i: bytes(alphabet[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    return plain | {a["id"]: a["content"].encode() for a in spec["added_tokens"]}


def decode_ids(bytes_of: dict[int, bytes], ids: Iterable[int]) -> str:
    return b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class TrieBPE:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-level BPE without normalizer or prefix space")
        vocab = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = token_bytes(spec)
        self.plain = regex.compile(WORDS).findall
        later = WORDS.replace(r"[^\s\p{L}\p{N}]", r"[^\s[\p{L}\p{N}--[LATER]]]").replace(r"\p{L}+", r"[\p{L}--[LATER]]+").replace(r"\p{N}+", r"[\p{N}--[LATER]]+")
        self.careful = regex.compile("(?V1)" + later.replace("LATER", LATER)).findall
        self.has_later = re.compile("[" + LATER + "]").search
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.special else None
        self._merges(model["merges"], vocab)
        self.cache: dict[str, bytes] = {}

    def _merges(self, merges: list, vocab: dict[str, int]) -> None:
        """Ranks by pair; of each token its two parts and the rank at which they become it."""
        self.rank = rank = {}
        made = {b for pair in merges for b in ["".join(pair if isinstance(pair, list) else pair.split(" "))]}
        self.made_at: dict[int, int] = {i: -1 for s, i in vocab.items() if s not in made}
        self.parts: dict[int, tuple[int, int]] = {}
        usable = {i for i in self.made_at if len(self.bytes_of[i]) == 1}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        for r, (a, b) in enumerate(pairs):
            rank.setdefault(vocab[a] << 32 | vocab[b], r)
        for r, (a, b) in enumerate(pairs):
            u, t, new = vocab[a], vocab[b], vocab[a + b]
            if new in self.made_at:
                continue  # the token is made by an earlier merge
            if self.made_at.get(u, r) >= r or self.made_at.get(t, r) >= r:
                raise ValueError("a merge comes before its parts")
            self.made_at[new], self.parts[new] = r, (u, t)
            if u in usable and t in usable and self._apart(u, t, r):
                usable.add(new)
        self._matcher(sorted(usable, key=lambda i: len(self.bytes_of[i])))
        self.apart: dict[int, bool] = {}

    def _matcher(self, usable: list[int]) -> None:
        """An automaton over all tokens: after each byte, the tokens that end there, the longest first."""
        step: dict[int, int] = {}
        ends: list[tuple[tuple[int, int], ...]] = [()]
        back = [0]
        nodes: dict[bytes, int] = {b"": 0}
        token = {self.bytes_of[i]: i for i in usable}
        prefixes = sorted({s[:k] for s in token for k in range(1, len(s) + 1)}, key=len)
        for s in prefixes:
            parent, byte = nodes[s[:-1]], s[-1]
            node = nodes[s] = len(ends)
            at = back[parent]
            while parent and (to := step.get(at << 8 | byte)) is None and at:
                at = back[at]
            fall = (to or 0) if parent else 0
            back.append(fall)
            own = ((token[s], len(s)),) if s in token else ()
            ends.append(own + ends[fall])
            step[parent << 8 | byte] = node
        self.step, self.ends, self.back = step, ends, back

    def _move(self, node: int, byte: int) -> int:
        at = node
        while (to := self.step.get(at << 8 | byte)) is None and at:
            at = self.back[at]
        self.step[node << 8 | byte] = to = to or 0
        return to

    def _apart(self, u: int, t: int, until: int) -> bool:
        """No merge crosses from u to t before rank `until`. Of equal merges the left one comes first."""
        rank, parts, made_at = self.rank, self.parts, self.made_at
        p, p_end = u, until
        while True:  # pieces on the right edge of u, each with the rank at which it is merged on
            q, q_end = t, until
            while True:
                r = rank.get(p << 32 | q)
                if r is not None and r < until and r < p_end and r <= q_end:
                    return False
                if q not in parts:
                    break
                q, q_end = parts[q][0], made_at[q]
            if p not in parts:
                return True
            p, p_end = parts[p][1], made_at[p]

    def _states(self, words: list[bytes]) -> Iterator[list[int]]:
        """The encoding of each word; words are sorted, so that this is a depth-first walk of their trie."""
        step, ends, apart = self.step, self.ends, self.apart
        last: list[int] = [-1]  # by depth: the last token, where it begins, and the automaton's state
        begin: list[int] = [0]
        state: list[int] = [0]
        previous = b""
        if len(apart) > CACHED_PAIRS:
            apart.clear()
        for word in words:
            n = len(word)
            shared = 0
            top = min(n, len(previous))
            if word[:top] == previous[:top]:
                shared = top
            else:
                while word[shared] == previous[shared]:
                    shared += 1
            del last[shared + 1 :], begin[shared + 1 :], state[shared + 1 :]
            node = state[-1]
            for depth in range(shared, n):
                byte = word[depth]
                to = step.get(node << 8 | byte)
                node = self._move(node, byte) if to is None else to
                for t, size in ends[node]:
                    start = depth + 1 - size
                    if start == 0:
                        break
                    pair = last[start] << 32 | t
                    ok = apart.get(pair)
                    if ok is None:
                        ok = apart[pair] = self._apart(last[start], t, 1 << 62)
                    if ok:
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[: depth + 1]!r}")
                last.append(t)
                begin.append(start)
                state.append(node)
            previous = word
            ids, at = [], n
            while at:
                ids.append(last[at])
                at = begin[at]
            ids.reverse()
            yield ids

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each distinct word as native 32-bit numbers, among those of earlier words."""
        words = list(words)
        if len(self.cache) + len(words) > CACHED_WORDS:
            cache = self.cache
            self.cache = {w: cache[w] for w in words if w in cache}
        cache = self.cache
        new = {w.encode(): w for w in words if w not in cache}
        order = sorted(new)
        for word, ids in zip(order, self._states(order), strict=True):
            cache[new[word]] = array("i", ids).tobytes()
        return cache

    def words(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or not self.has_later(text) else self.careful(text)

    def cut(self, text: str) -> list[str]:
        """Words and special tokens in the order of the text."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.cut_special(text)):
            out += [part] if i % 2 else self.words(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native 32-bit numbers."""
        cuts = [self.cut(t) for t in texts]
        distinct = set().union(*cuts) if cuts else set()
        specials = {s: array("i", [i]).tobytes() for s, i in self.special.items() if s in distinct}
        known = self.encode_words(distinct - specials.keys())
        if specials:
            known = known | specials
        of = known.__getitem__
        return [b"".join(map(of, words)) for words in cuts]

    def decode(self, ids: Iterable[int]) -> str:
        return decode_ids(self.bytes_of, ids)


def _model(kind: str, source: bytes):
    key = hash(source)
    if kind not in HELD or HELD[kind][0] != key:
        HELD[kind] = key, TrieBPE(source) if kind == "encode" else token_bytes(json.loads(source))
    return HELD[kind][1]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCAB_BYTES + 1)
    if len(data) > MOST_VOCAB_BYTES:
        raise ValueError(f"a vocabulary may have {MOST_VOCAB_BYTES} bytes")
    return data


#: Rows whose new words share one trie. More share more; memory is that of their words.
ROWS = 1024


def ids_array(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(ids) // 4 for ids in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


def texts_array(bytes_of: dict[int, bytes], column: pa.ListArray) -> pa.Array:
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return pa.array([decode_ids(bytes_of, flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """id, ids array<int> of every whole text, and with `back` the text that the ids decode to, as decoded.

    vocabulary: the driver's path of the vocabulary's JSON.
    """
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model("encode", held.value)
        for batch in sliced(batches, ROWS, keep=True):
            ids = ids_array(model.encode_batch(as_texts(batch.column("text"))))
            columns, names = [batch.column("id"), ids], ["id", "ids"]
            if back:
                columns, names = [*columns, texts_array(model.bytes_of, ids)], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = pick(df, id=id_col, text=text_col)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * back)


def decode(df: DataFrame, vocabulary: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, ids, text: special tokens stay, broken UTF-8 becomes U+FFFD; null ids give the empty text."""
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _model("decode", held.value)
        for batch in sliced(batches, ROWS, keep=True):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), texts_array(bytes_of, batch.column("ids"))], names=["id", "ids", "text"])

    source = pick(df, id=id_col, ids=ids_col)
    source = source.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, text string")


def op2_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded, decoded again, and both digested."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = encode(table(spark, sf_dir, "documents"), path, back=True)
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
