"""Vocabulary, configuration, errors and the schemas of a case's collections."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

# The vocabulary of saved cases.
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "DOCUMENT", "OTHER")
EVENT_TYPES = ("COMMUNICATION", "MEETING", "DECISION", "TRANSACTION", "ACTION", "OTHER")
CLAIM_KINDS = ("EVENT", "RELATIONSHIP")
POLARITIES = ("AFFIRMED", "NEGATED", "UNKNOWN")
MODALITIES = ("ASSERTED", "POSSIBLE", "ALLEGED", "CONDITIONAL", "UNKNOWN")
PRECISIONS = ("INSTANT", "DAY", "MONTH", "YEAR", "RANGE", "UNRESOLVED")
STAGES = ("PARSE", "EXTRACT", "RESOLVE", "GRAPH")
FAILURE_CODES = ("SOURCE_UNAVAILABLE", "UNSUPPORTED_FORMAT", "ENCRYPTED", "OCR_REQUIRED", "LIMIT_EXCEEDED", "MALFORMED", "LOADER_FAILED", "EXTRACTION_FAILED", "ADAPTER_CONTRACT")
REVIEW_ACTIONS = ("ACCEPT", "REJECT", "MERGE_ENTITIES", "UNMERGE_ENTITY", "GROUP_EVENTS", "UNGROUP_EVENT", "SET_CANONICAL_NAME")
SEGMENT_KINDS = ("page", "paragraph", "sentence", "field", "attachment", "sheet", "cell")


class TracewellError(Exception):
    """Base of all errors of this library."""


class SourceError(TracewellError):
    """No usable source was given."""


class ConfigurationError(TracewellError):
    """A setting is out of range, or a needed model is missing."""


class ResourceLimitError(TracewellError):
    """A configured limit was passed."""


class AmbiguousReferenceError(TracewellError):
    """A name stands for several graph nodes."""


class ReviewDecisionError(TracewellError):
    """A review decision is malformed or conflicts with another."""


class CompatibilityError(TracewellError):
    """A saved case has an unknown format or version."""


class IntegrityError(TracewellError):
    """Records of a case contradict each other."""


class PersistenceError(TracewellError):
    """A case couldn't be saved or loaded."""


class AdapterConflictError(TracewellError):
    """Two adapters claim one name or suffix."""


class AdapterContractError(TracewellError):
    """An adapter returned something that its contract forbids."""


class BuildFailed(TracewellError):
    """A strict build had failures; ``report`` holds what was reached."""

    def __init__(self, message: str, report=None):
        super().__init__(message)
        self.report = report


@dataclass(frozen=True)
class CaseConfig:
    """Thresholds and budgets of a build.  ``strict_limits`` turns passed resolution budgets into errors."""

    accept_threshold: float = 0.90
    review_threshold: float = 0.60
    auto_merge_threshold: float = 0.98
    max_file_bytes: int = 25 * 1024 * 1024
    max_files: int = 10_000
    max_depth: int = 64
    max_total_bytes: int = 1024 * 1024 * 1024
    max_extracted_chars: int = 1_000_000
    max_pdf_pages: int = 2_000
    max_pdf_word_boxes: int = 250_000
    max_docx_members: int = 10_000
    max_docx_uncompressed_bytes: int = 64 * 1024 * 1024
    max_docx_member_bytes: int = 32 * 1024 * 1024
    max_docx_compression_ratio: float = 100.0
    max_resolution_candidates: int = 100_000
    max_resolution_block_size: int = 500
    follow_symlinks: bool = False
    default_timezone: str | None = None
    language: str = "en"
    strict_limits: bool = True

    def __post_init__(self) -> None:
        for name in ("accept_threshold", "review_threshold", "auto_merge_threshold"):
            value = getattr(self, name)
            if not (isinstance(value, (int, float)) and math.isfinite(value) and 0 <= value <= 1):
                raise ConfigurationError(f"{name} must be from 0 to 1")
        if self.review_threshold > self.accept_threshold:
            raise ConfigurationError("review_threshold must not exceed accept_threshold")
        for name, value in asdict(self).items():
            if name.startswith("max_") and value < 1:
                raise ConfigurationError(f"{name} must be positive")
        if self.language != "en":
            raise ConfigurationError("only English rules are available")


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # type: ignore[attr-defined]


TRANSITIONS = "array<struct<idx:int,delta:int>>"
SEGMENT = "struct<kind:string,raw_start:int,raw_end:int,page:int,paragraph:int,sentence:int,field:string,label:string>"
BOX = "struct<raw_start:int,raw_end:int,page:int,x0:double,y0:double,x1:double,y1:double>"
TEMPORAL = "struct<original_text:string,start:string,end:string,precision:string,timezone:string,is_relative:boolean,resolved:boolean,evidence_span_id:string>"
PARTICIPANT = "struct<role:string,mention_id:string,entity_id:string,literal:string>"

#: Collections of a case as DDL; the order is that of a saved case.
COLLECTIONS: dict[str, str] = {
    "source_references": "id string, path string, filename string, media_type string, size_bytes long, content_sha256 string, metadata string",
    "documents": f"id string, content_sha256 string, source_reference_ids array<string>, media_type string, raw_text string, normalized_text string, offset_transitions {TRANSITIONS}, segments array<{SEGMENT}>, boxes array<{BOX}>, headers map<string,array<string>>, reference string, metadata string, parser_name string, parser_version string",
    "evidence_spans": "id string, document_id string, raw_start int, raw_end int, normalized_start int, normalized_end int, quote string, page int, paragraph int, sentence int, field string, boxes array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>",
    "mentions": "id string, evidence_span_id string, entity_type string, text string, normalized_text string, extractor_name string, extractor_version string, score double, accepted boolean",
    "temporals": f"document_id string, {TEMPORAL.removeprefix('struct<').removesuffix('>').replace(':', ' ')}, score double",
    "claims": f"id string, kind string, predicate string, participants array<{PARTICIPANT}>, evidence_span_ids array<string>, polarity string, modality string, temporal array<{TEMPORAL}>, extractor_name string, extractor_version string, score double, accepted boolean",
    "entities": "id string, type string, canonical_name string, aliases array<string>, mention_ids array<string>, score double",
    "events": f"id string, type string, title string, claim_ids array<string>, participant_entity_ids array<string>, temporal array<{TEMPORAL}>, score double, provisional boolean",
    "relationships": "id string, source_id string, target_id string, type string, supporting_claim_ids array<string>, opposing_claim_ids array<string>, score double",
    "review_items": "id string, kind string, target_ids array<string>, reason string, score double, evidence_span_ids array<string>",
    "review_decisions": "seq long, id string, action string, target_ids array<string>, payload string, reason string, supersedes string",
    "failures": "code string, message string, source_reference_id string, stage string, exception_type string",
    "build_results": "source_reference_id string, document_id string, completed_stage string, failures array<struct<code:string,message:string>>, warnings array<string>, succeeded boolean",
}


def schema(name: str) -> T.StructType:
    """The schema of a collection; needs a running session."""
    return _struct(COLLECTIONS[name])
