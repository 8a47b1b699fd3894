"""Secrets in texts: three base patterns, and strings of high novelty in a sensitive context.

Novelty is measured with zstandard: a compressor primed with a dictionary of identifiers compresses the text around a
candidate without and with the candidate; the difference is the candidate's marginal size. Identifiers, words and
repeated strings cost few bytes, random ones most of their length. A candidate is reported if a sensitive word stands
shortly before it and its marginal size reaches ``ratio`` of its length.

Defined cases: a null or empty text has no spans; repeated rows are each scanned; an empty table gives no rows; other
columns are ignored. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, whole_text

KINDS = ("assign", "access", "hex")
#: Fixed patterns of the base spans, with the least length of the group that decides.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates are whole runs of these signs, of ``SHORTEST`` or more.
RUN, SHORTEST = re.compile(r"[A-Za-z0-9+/_=-]+"), 12
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api.?key|private.?key|access.?key|credential|bearer|auth|signature|salt|\bpwd\b|\bpin\b|\bkey\b", re.ASCII | re.IGNORECASE)
#: What code and configuration files say anyway: the dictionary that primes the compressor.
IDENTIFIERS = """
abstract access_key account address admin alias allow_origins api_key application argument array assert async attribute
auth_token authorization await backend base64 basic bearer boolean branch break bucket buffer build_number byte cache
callback catch channel char checksum class client_id client_secret cluster column command commit_hash component config
configuration connection_string const constructor container content_type context continue controller cookie count
created_at credentials cursor customer_id database_url datetime debug default delete deployment description digest
directory dispatch document domain double download driver element else email enabled encoding encrypted endpoint
environment error event example except exception execute export extends external factory false fetch field file_name
filter final finally float folder for foreign_key format function gateway generate getter github global handler hash
header hexdigest hidden host_name http https identifier if implements import include index info init input insert
instance integer interface internal iterator java javascript json_payload key_id lambda language length library license
limit listener local localhost location logger login long manager map master max_length message metadata method middleware
migration min_length mode model module namespace native network new_value node none not_null null number object offset
operator optional options order_by output package page parameter parent parse partition passphrase password path pattern
payload permission pipeline placeholder platform plugin pointer port position postgres prefix primary_key print private
private_key process production profile project_name promise property protected protocol provider proxy public_key python
query queue raise random range raw read_only receiver record redirect_uri refresh_token region register release remote
replace repository request required resource response result return role root_path route runtime sample schema scope
script search secret_key section security select self sequence serializer server service session_id setter settings sha256
short signature size source_code spring sql_query stack staging static status_code storage stream string struct style
submit subscription suffix super switch symbol synchronized system table target template temporary test_case thread
throw timeout timestamp title token_type trace transaction transform trigger true try type undefined unique_id unsigned
update_at upload url user_agent user_id user_name username utf8 uuid validate value variable vector vendor verify version
view virtual visible void volatile warning webhook while widget window worker workspace wrapper write xml yaml yield zone
"""
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


class Novelty:
    def __init__(self, level: int = 3):
        # raw content works as a prefix to refer back to
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def marginal(self, text: str, start: int, end: int, around: int = 256) -> float:
        """Share of the candidate's bytes that its presence adds to the compressed size of what stands around it."""
        before, after = text[max(0, start - around) : start].encode(), text[end : end + around].encode()
        candidate = text[start:end].encode()
        # twice the context first: only the candidate's own novelty is left in the difference
        without = len(self.compressor.compress(before + after + b"\n" + before))
        with_it = len(self.compressor.compress(before + after + b"\n" + before + candidate))
        return (with_it - without) / len(candidate)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty, before: int, ratio: float) -> list[tuple[str, int, int]]:
    """Candidates behind a sensitive word, away from base spans, whose marginal size reaches ``ratio``."""
    out, seen = [], 0
    for word in SENSITIVE.finditer(text):
        at, last = max(seen, word.end()), word.end() + before
        # a run starts at ``last`` or before, and ends where it ends
        while at <= last and (found := RUN.search(text, at, last + 1)):
            a, b = found.start(), RUN.match(text, found.start()).end()
            at = b
            if b - a < SHORTEST or a and RUN.match(text, a - 1):
                continue  # too short, or the tail of a longer string
            seen = b
            token = text[a:b]
            if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
                continue
            if any(s < b and a < e for _, s, e in base):
                continue
            if novelty.marginal(text, a, b) >= ratio:
                out.append(("novel", a, b))
    return out


def find(docs: DataFrame, before: int = 48, ratio: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each text (code points, ends exclusive) by start, then kind: base kinds as listed, then ``novel``."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                every = base + novel_spans(text, base, novelty, before, ratio)
                every.sort(key=lambda s: (s[1], (*KINDS, "novel").index(s[0])))
                out.append([dict(zip(("kind", "start", "end"), s)) for s in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], ["doc_id", "spans"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, SCHEMA)
