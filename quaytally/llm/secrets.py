"""Secret scan: three fixed pattern kinds, and strings that a primed compressor cannot shorten.

A candidate is a long run of secret-like characters with a sensitive word shortly before it. Of a run
NAME=value without spaces the value is the candidate, and the name is part of what stands before it;
where no part of a run is novel by itself, the whole run is looked at. Its
novelty is the number of bytes that it adds to the Zstandard frame of the surrounding text, whose
compressor is primed with a dictionary of identifiers (a short fixed list, and the commonest of the
documents themselves, counted in a pass of their own), as a share of what the same bytes add out of order. Words and names that the dictionary or the surroundings know add much less; random keys
add as much. What repeats itself adds fewer bytes than its letters hold by their shares alone, and what has next to no
different letters holds few: neither is novel. Long keys of few letters (hex, digits) are, as they cost what they hold.

Nulls and empty texts have no spans (their base_sha256 is that of the empty string). Texts of any
length are scanned whole, each by itself. Repeated rows give repeated results, a null id stays null,
an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaytally.llm.common import chunks, texts

#: The kinds, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "novel")
# Fixed values of the pattern kinds: words that open an assignment, least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")

#: Words that make the text shortly after them sensitive.
CONTEXT = re.compile(r"pass(?:word|wd|phrase)|secret|token|api_?key|credential|authori[sz]ation|bearer|private|access_?key|client_?id|signature|session|cookie|login", re.IGNORECASE | re.ASCII)
CONTEXT_WORDS = (b"passw", b"passphrase", b"secret", b"token", b"apikey", b"api_key", b"credential", b"authori", b"bearer", b"private", b"accesskey", b"access_key", b"clientid", b"client_id", b"signature", b"session", b"cookie", b"login")
CANDIDATE_LEAST, CONTEXT_REACH, AROUND, NOVELTY, LEVEL = 20, 48, 256, 0.94, 12
#: Bytes that the letters of a string of CANDIDATE_LEAST characters hold at least, by their shares alone, and the share of what they hold that it must cost.
LEAST_BYTES, LEAST_SHARE = 6.0, 0.9
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{CANDIDATE_LEAST},}}")
NAMED = re.compile(r"[A-Za-z0-9+/_.-]+=+(?=[A-Za-z0-9+/_.-])")
PART = re.compile(rf"[A-Za-z0-9+/_.-]{{{CANDIDATE_LEAST},}}=*")

#: What code and configuration usually say; primes the compressor, together with the corpus's own identifiers.
IDENTIFIERS = """
password passwd secret token api_key apikey access_key secret_key client_id client_secret private_key
public_key authorization bearer username user_name user_id session_id request_id account_id database_url
connection_string environment variable configuration credentials encryption certificate signature
application service endpoint hostname localhost example production development staging test_mode
true false null none undefined function return import export default const string number boolean object
https://www.example.com/ http://localhost:8080/ /usr/local/bin/ /var/lib/ /home/user/ index.html
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ placeholder changeme your_token_here
AAAAAAAAAAAAAAAA 0000000000000000 xxxxxxxxxxxxxxxx the and that with for this from have are was not
""".encode()
#: Identifiers of the corpus that prime the compressor, those of most documents first, and the fewest documents they have.
MOST_IDENTIFIERS, LEAST_DOCUMENTS = 4096, 3
IDENTIFIER = re.compile(rb"[A-Za-z_]{3,}")
SHORT_RUN = re.compile(rb"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{3,%d}(?![A-Za-z0-9+/_=.-])" % (CANDIDATE_LEAST - 1))


def has_context(raw: bytes) -> bool:
    low = raw.lower()
    return any(x in low for x in CONTEXT_WORDS)


def corpus_identifiers(docs: DataFrame, text: str = "text", most: int = MOST_IDENTIFIERS, least: int = LEAST_DOCUMENTS) -> bytes:
    """The commonest identifiers of all documents that say a sensitive word anywhere, as a dictionary.

    They are counted by document, outside of strings long enough to be a secret: else one that is copied
    often would be known. The result is a bounded number of short words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in chunks(batches):
            found: Counter[bytes] = Counter()
            for raw in raws:
                if has_context(raw):
                    found.update(set(IDENTIFIER.findall(b" ".join(SHORT_RUN.findall(raw)))))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    counts = texts(docs, text=text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]
    return " ".join(reversed(words)).encode()  # the commonest stand nearest to what is compressed


def letters_hold(own: bytes) -> float:
    """Bytes that the letters of a string cost by their shares in it, whatever their order."""
    counts = np.array([*Counter(own).values()], float)
    return float((counts * np.log2(len(own) / counts)).sum() / 8)


class Novelty:
    """Bytes that a string adds to its compressed surroundings, as a share of what its mixed bytes add."""

    def __init__(self, identifiers: bytes = b""):
        primed = zstandard.ZstdCompressionDict(identifiers + b"\n" + IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_dict_id=False)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        around = (after + before).encode("utf-8", "replace")
        own = candidate.encode()
        least = len(self.compressor.compress(around))
        cost = len(self.compressor.compress(around + own)) - least
        alone = letters_hold(own)
        if alone < LEAST_BYTES or cost < LEAST_SHARE * alone:
            return 0.0
        # the same bytes without their order: what they cost if nothing is known of them
        mixed = np.random.default_rng(len(own)).permutation(np.frombuffer(own, np.uint8)).tobytes()
        return cost / max(1, len(self.compressor.compress(around + mixed)) - least)


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, whole matches."""
    low = raw.lower()
    found = []
    if any(x in low for x in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def novel_spans(text: str, raw: bytes, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Incompressible strings in sensitive context."""
    if not has_context(raw):
        return []
    found = []

    def is_novel(start: int, end: int, reach_from: int) -> bool:
        before, context = text[max(0, start - AROUND) : start], text[max(0, reach_from - CONTEXT_REACH) : start]
        return CONTEXT.search(context) is not None and novelty(before, text[start:end], text[end : end + AROUND]) >= least

    for m in CANDIDATE.finditer(text):
        own = []
        if named := NAMED.match(m[0]):  # the value behind the leading name
            start = m.start() + named.end()
            if m.end() - start >= CANDIDATE_LEAST and is_novel(start, m.end(), m.start()):
                own = [(start, m.end())]
            # else each part between the signs, with the names before it
            own = own or [(a, b) for p in PART.finditer(text, m.start(), m.end()) if is_novel(a := p.start(), b := p.end(), a)]
        if not own and is_novel(*m.span(), m.start()):
            own = [m.span()]
        found += [(*s, "novel") for s in own]
    return found


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


SPANS = "doc_id long, kind string, start long, end long, found string"


def secret_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = NOVELTY, identifiers: bytes | None = None) -> DataFrame:
    """One row per span found: doc_id, kind, start, end, found (the text of the span). Without identifiers, those of docs are taken."""
    identifiers = corpus_identifiers(docs, text) if identifiers is None else identifiers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for part, raws in chunks(batches):
            rows = []
            for key, raw in zip(part.column(0).to_pylist(), raws):
                whole = raw.decode("utf-8", "replace")
                rows += [(key, kind, start, end, whole[start:end]) for start, end, kind in base_spans(whole, raw) + novel_spans(whole, raw, novelty, least)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "kind", "start", "end", "found"])

    return texts(docs, F.col(id).alias("doc_id"), text=text).mapInArrow(scan, SPANS)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def secret_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = NOVELTY, identifiers: bytes | None = None) -> DataFrame:
    """One row per document: counts by kind, the hash of the listed pattern spans, all spans listed."""
    identifiers = corpus_identifiers(docs, text) if identifiers is None else identifiers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for part, raws in chunks(batches):
            counts, hashes, lists = {k: [] for k in KINDS}, [], []
            for raw in raws:
                whole = raw.decode("utf-8", "replace")
                base, novel = base_spans(whole, raw), novel_spans(whole, raw, novelty, least)
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base + novel))
                hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(base + novel))
            n = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
            yield pa.RecordBatch.from_arrays(
                [part.column(0), n["assign"], n["access"], n["hex"], pa.array(hashes, pa.string()), pa.array(lists, pa.string()), n["novel"]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
            )

    return texts(docs, F.col(id).alias("doc_id"), text=text).mapInArrow(scan, DIGEST)
