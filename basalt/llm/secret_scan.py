"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what they miss.

The patterns (assign, access, hex) are a base that always stays. The method adds candidates that
stand in a sensitive context: an unbroken run of key-like characters with a letter, after a word that names a credential on
its own line or the line before. A candidate's novelty is its marginal size: the bytes that zstandard needs for it
once it has seen, as a dictionary, common identifiers of code and the text around the candidate. Words,
identifiers and repeats of the surroundings cost little; random material costs most of what its symbols need.
A lone word is too short for the coder to save on. So candidates of letters with a digit at most must also be unlike words: their
letters follow each other as they rarely do in the identifiers and the text around.

A run that base spans cover in part is measured as a whole, and so is what they leave of it; where either is novel the whole run is a span. What
surrounds a candidate is `around` characters on each side, which a caller may set.

Texts are scanned whole, row by row: no shuffle, no driver state. Defined results: a null text is the
empty text; a text without spans gives an empty list; repeated rows give repeated results; ties (spans
that begin together) are ordered by kind as in KINDS; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import as_binary, pick, sliced, small_batches, table

KINDS = ("assign", "access", "hex", "novel")
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: What a text must hold for a pattern to have any match, in the linear-time engine of Arrow.
SIEVE = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "novel": r"(?i)(passw|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|signature)"}
CONTEXT = re.compile(r"passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|signature", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Where the context of a sensitive word ends: at the end of the line after its own.
CONTEXT_END = re.compile(r"\n[^\n]*(?=\n)|\Z")
#: Characters on each side of a candidate that are its surroundings.
AROUND = 400
#: Marginal bytes for each byte that the candidate costs without a dictionary, at least.
NOVEL = 0.7
#: Sets of symbols that keys are drawn from (in lower case), and the share of their entropy that a long candidate costs at least.
ALPHABETS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz234567=", "abcdefghijklmnopqrstuvwxyz0123456789")
OF_ENTROPY = 0.95
#: Bits for each pair of neighbouring symbols, at least, of candidates with fewer than two digits. Words have 3.4 on average, random letters 6.2.
UNLIKE = 5.0
#: Fixed text of common identifiers and words of code.
IDENTIFIERS = (
    "abstract account address algorithm application argument array assert async attribute authenticate authorization await "
    "base64 begin boolean break buffer bytes callback catch certificate char class client close cluster collection column command "
    "commit compare component config configuration connection const constructor container content context continue controller "
    "cookie copy count create credential current cursor data database date debug decode decrypt default define delete description "
    "destination device dictionary digest directory document domain double download dynamic element email enable encode encrypt endpoint "
    "environment error event example exception execute export extends factory false field file filter final finally float "
    "format function generate getter global group handler hash header host http https identifier image implements import index "
    "initialize input insert instance integer interface internal iterator javascript json kernel key keyword lambda language length "
    "library license list listener load local localhost location lock logger login long manager map master memory message metadata method "
    "model module mutex name namespace network node null number object offset operation option output override package page parameter "
    "parent parse password path pattern payload permission placeholder platform plugin pointer policy port prefix primary private process "
    "production profile project property protected protocol provider proxy public python query queue random read record redirect "
    "reference regex register release remote remove render repository request require reset resource response result return "
    "role root route router sample scheduler schema scope script search secret select server service session setting signature size "
    "socket source stack standard start state static status storage stream string struct style suffix super switch symbol sync system table "
    "target task template test text thread throw timeout timestamp token trace transaction transform true type undefined unique update upload "
    "user username util validate value variable vector version view virtual void volume while window worker wrapper write your_api_key_here "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ changeme xxxxxxxxxxxxxxxx ================ ---------------- ________________"
)


def pair_counts(text: str) -> Counter:
    """Neighbouring symbols: letters in lower case, # for digits, a blank for runs of anything else."""
    symbols = re.sub("[^a-z#]+", " ", re.sub("[0-9]", "#", text.lower()))
    return Counter(zip(symbols, symbols[1:]))


IDENTIFIER_PAIRS = pair_counts(IDENTIFIERS.split("0123456789")[0])


def base_spans(text: str, kinds: tuple[str, ...] = ("assign", "access", "hex")) -> list[tuple[int, int, str]]:
    out = []
    for kind in kinds:
        group = 2 if kind == "assign" else 0
        out += [(m.start(), m.end(), kind) for m in BASE[kind].finditer(text) if m.end(group) - m.start(group) >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def marginal_bytes(candidate: str, before: str, after: str, level: int = 19) -> int:
    """Bytes that the candidate adds for a coder primed with identifiers and the text around it, all in lower case."""
    primer = (IDENTIFIERS + "\n" + after + "\n" + before).lower().encode("utf-8", "surrogatepass")
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(primer, zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(coder.compress(candidate.lower().encode())) - len(coder.compress(b""))


def is_novel(candidate: str, before: str, after: str, least: float = NOVEL) -> bool:
    """Whether priming saves little of the candidate, measured against what its own symbols allow.

    Random keys of few symbols cost less than a byte a character once they are long, so the bound is a share of the size without
    a dictionary there; what repeats itself is small without one too, and stays below the entropy of its alphabet.
    """
    size, length = marginal_bytes(candidate, before, after), len(candidate)
    if size >= least * length:
        return True
    symbols = next((len(a.rstrip("=")) for a in ALPHABETS if set(candidate.lower()) <= set(a)), len(ALPHABETS[-1]))
    if size < OF_ENTROPY * math.log2(symbols) / 8 * length:
        return False
    coder = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)
    return size >= least * (len(coder.compress(candidate.lower().encode())) - len(coder.compress(b"")))


def pair_bits(candidate: str, before: str, after: str) -> float:
    """Mean bits of a symbol of the candidate after the one before it, by the pairs of identifiers and the text around."""
    known, heads = IDENTIFIER_PAIRS + pair_counts(before + " " + after), Counter()
    for (first, _), n in known.items():
        heads[first] += n
    own = pair_counts(candidate)
    return sum(-n * math.log2((known[p] + 0.3) / (heads[p[0]] + 0.3 * 28)) for p, n in own.items()) / max(1, own.total())


def in_context(text: str) -> Iterator[tuple[int, int]]:
    """Key-like runs after sensitive words, up to the end of the next line, each once."""
    stretches: list[list[int]] = []
    for word in CONTEXT.finditer(text):
        if stretches and word.start() <= stretches[-1][1]:
            if word.end() > text.rfind("\n", 0, stretches[-1][1]):  # on the stretch's last line
                stretches[-1][1] = CONTEXT_END.search(text, word.end()).end()
        else:
            stretches.append([word.end(), CONTEXT_END.search(text, word.end()).end()])
    for at, end in stretches:
        for m in CANDIDATE.finditer(text, at, end):
            yield m.span()


def is_secret(own: str, before: str, after: str, least: float) -> bool:
    digits, letters = sum(c.isdigit() for c in own), sum(c.isalpha() for c in own)
    return letters > 0 and is_novel(own, before, after, least) and (digits >= 2 or pair_bits(own, before, after) >= UNLIKE)


def novel_spans(text: str, taken: list[tuple[int, int, str]], least: float = NOVEL, around: int = AROUND) -> list[tuple[int, int, str]]:
    """Incompressible key-like strings in a sensitive context that no span of `taken` covers."""
    out = []
    for start, end in in_context(text):
        if start and text[start - 1] in "+/_=-":
            continue
        covered, left, at = False, [], start
        for s, e, _ in taken:  # by start
            if s < end and start < e:
                covered |= s <= start and end <= e
                left.append((at, s))
                at = max(at, e)
        left += [(at, end), *((w.end(), end) for w in CONTEXT.finditer(text, start, end))]  # what base spans leave, and what follows a sensitive word
        parts = [(start, end), *((s, e) for s, e in left if 16 <= e - s < end - start)]
        if not covered and any(is_secret(text[s:e], text[max(0, s - around) : s], text[e : e + around], least) for s, e in parts):
            out.append((start, end, "novel"))
    return out


def find_secrets(text: str, kinds: tuple[str, ...] = KINDS, around: int = AROUND) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, code points with the end exclusive, by start and then kind."""
    base = base_spans(text, tuple(k for k in kinds if k != "novel"))
    return sorted(base + (novel_spans(text, base, around=around) if "novel" in kinds else []), key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = AROUND) -> DataFrame:
    """id, spans array<struct<start, end, kind>> for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in sliced(batches, 512):
            texts = as_binary(batch.column("text"))
            spans: list[list] = [[] for _ in range(len(texts))]
            hits = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in SIEVE.items()}
            for i in (hits["assign"] | hits["access"] | hits["hex"] | hits["novel"]).nonzero()[0]:
                kinds = tuple(k for k in KINDS if hits[k][i])
                spans[i] = [{"start": s, "end": e, "kind": k} for s, e, k in find_secrets(texts[i].as_py().decode(), kinds, around)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind_type)], names=["id", "spans"])

    source = pick(df, id=id_col, text=text_col)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<start:int,end:int,kind:string>>")


def redact(text: str, spans: list, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append(list(s))
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with the secrets of its text column replaced by a mark; null texts stay null, other columns as they are."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            texts = as_binary(batch.column(at))
            hits = None
            for p in SIEVE.values():
                found = pc.match_substring_regex(texts, p)
                hits = found if hits is None else pc.or_(hits, found)
            if pc.any(hits).as_py():
                new = batch.column(at).to_pylist()
                for i in hits.to_numpy(zero_copy_only=False).nonzero()[0]:
                    spans = [{"start": s, "end": e} for s, e, _ in find_secrets(new[i] or "")]
                    new[i] = redact(new[i], spans, mark) if spans else new[i]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch

    return df.mapInArrow(run, df.schema)


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, its base spans counted and hashed, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        of("novel"),
    )
