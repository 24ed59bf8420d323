"""Search and ingest requests: validation, defaults, and the forms they come in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from tidemark.functions import INSTANT
from tidemark.schema import InvalidRequest, Limits

_INSTANT = re.compile(INSTANT)
#: What Java's isBlank skips: white space without the no-break kinds, and the control characters it counts in.
_NO_BREAK = "   \x85"
_CONTROLS = "\x1c\x1d\x1e\x1f\t\n\x0b\x0c\r"


def is_blank(text: str | None) -> bool:
    return text is None or all((c.isspace() and c not in _NO_BREAK) or c in _CONTROLS for c in text)


def instant(text: str) -> tuple[int, int]:
    """(epoch seconds, nanoseconds) of an ISO instant."""
    if not _INSTANT.match(text):
        raise ValueError(f"not an instant: {text}")
    text = text.upper()
    at = re.match(r"([^.Z+]+?)(?:\.(\d*))?(Z|[+-]\d{2}(?::\d{2}){0,2})$", text)
    if not at:
        raise ValueError(f"not an instant: {text}")
    base, fraction, zone = at.groups()
    shift = timedelta(0)
    if zone != "Z":
        parts = [*map(int, zone[1:].split(":")), 0, 0][:3]
        shift = timedelta(hours=parts[0], minutes=parts[1], seconds=parts[2]) * (-1 if zone[0] == "-" else 1)
    when = datetime.strptime(base, "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc) - shift
    seconds = (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)
    return seconds, int((fraction or "").ljust(9, "0") or 0)


def instant_ms(text: str) -> int:
    """Epoch milliseconds, floored."""
    seconds, nanos = instant(text)
    return seconds * 1000 + nanos // 1_000_000


@dataclass(frozen=True)
class Query:
    """A search, validated: tenant, half-open range in epoch milliseconds, exact tags, literal text."""

    tenant_id: str
    from_ms: int
    to_ms: int
    tags: dict[str, str] = field(default_factory=dict)
    text: str | None = None
    limit: int = Limits.default_limit
    timeout_ms: int = Limits.default_timeout_ms


def search_query(request: dict, limits: Limits = Limits()) -> Query:
    """The query of a request, or InvalidRequest with everything that is wrong. A tag value of null is refused."""
    errors = []
    get = request.get
    if is_blank(get("tenant_id")):
        errors.append("tenant_id is required")
    errors += [f"{k} is required" for k in ("from", "to") if is_blank(get(k))]
    if not is_blank(get("from")) and not is_blank(get("to")):
        try:
            if instant(get("from")) >= instant(get("to")):
                errors.append("from must be before to")
        except ValueError:
            errors.append("Invalid timestamp format")
    for name, most in (("limit", limits.max_limit), ("timeout_ms", limits.max_timeout_ms)):
        if get(name) is not None and not 1 <= get(name) <= most:
            errors.append(f"{name} must be between 1 and {most}")
    if any(v is None for v in (get("tags") or {}).values()):
        errors.append("tag values must not be null")
    if errors:
        raise InvalidRequest(errors)
    pick = lambda name, default, most: min(get(name) if get(name) is not None else default, most)
    return Query(get("tenant_id"), instant_ms(get("from")), instant_ms(get("to")), dict(get("tags") or {}), get("text") or None, pick("limit", limits.default_limit, limits.max_limit), pick("timeout_ms", limits.default_timeout_ms, limits.max_timeout_ms))


def batch_errors(tenant_id: str | None, records: list[dict] | None, limits: Limits = Limits()) -> list[str]:
    """Everything that is wrong with a batch; timestamps are parsed afterwards. A null tag value is refused."""
    errors = []
    size = lambda s: len(s.encode())
    if is_blank(tenant_id):
        errors.append("tenant_id is required")
    elif size(tenant_id) > limits.max_tenant_bytes:
        errors.append("tenant_id exceeds maximum length")
    if not records:
        errors.append("records must not be empty")
    elif len(records) > limits.max_batch_records:
        errors.append(f"Too many records: max {limits.max_batch_records}")
    total = 0
    for i, r in enumerate(records or ()):
        errors += [f"records[{i}].{k} is required" for k in ("message", "timestamp") if is_blank(r.get(k))]
        tags = r.get("tags") or {}
        if len(tags) > limits.max_tags:
            errors.append(f"records[{i}] exceeds max tags: {limits.max_tags}")
        for k, v in tags.items():
            if size(k) > limits.max_tag_key_bytes:
                errors.append(f"records[{i}] tag key exceeds max length: {limits.max_tag_key_bytes}")
            if v is None:
                errors.append(f"records[{i}] tag value must not be null")
            elif size(v) > limits.max_tag_value_bytes:
                errors.append(f"records[{i}] tag value exceeds max length: {limits.max_tag_value_bytes}")
            total += size(k) + size(v or "")
        total += size(r.get("message") or "") + size(r.get("timestamp") or "")
    if total > limits.max_batch_bytes:
        errors.append(f"Batch exceeds maximum size: {limits.max_batch_bytes} bytes")
    return errors


def from_form(tenant_id: str, from_: str | None = None, to: str | None = None, tags: list[tuple[str, str]] = (), text: str = "", now: datetime | None = None) -> dict:
    """A request of what a form holds: fields trimmed, empty ones left out, times without a zone taken as UTC, the last hour by default."""
    now = now or datetime.now(timezone.utc)
    iso = lambda t: t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"
    parse = lambda s: (t if (t := datetime.fromisoformat(s)).tzinfo else t.replace(tzinfo=timezone.utc))
    out = {"tenant_id": tenant_id.strip(), "from": iso(parse(from_) if from_ else now - timedelta(hours=1)), "to": iso(parse(to) if to else now)}
    pairs = {k.strip(): v.strip() for k, v in tags if k.strip() and v.strip()}
    return out | ({"tags": pairs} if pairs else {}) | ({"text": text.strip()} if text.strip() else {})


def from_parsed(candidate: object) -> dict:
    """A request of what a translator made of natural language, checked field by field; ValueError says what is amiss."""
    if not isinstance(candidate, dict):
        raise ValueError("Response was not a JSON object")
    if not isinstance(candidate.get("tenant_id"), str) or not candidate["tenant_id"].strip():
        raise ValueError("Missing or invalid tenant_id")
    times = {}
    for k in ("from", "to"):
        try:
            t = datetime.fromisoformat(candidate.get(k))
            times[k] = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        except (TypeError, ValueError):
            raise ValueError(f"Missing or invalid {k} timestamp") from None
    if times["from"] >= times["to"]:
        raise ValueError("from must be before to")
    out = {k: candidate[k] for k in ("tenant_id", "from", "to")}
    if isinstance(candidate.get("tags"), dict):
        out["tags"] = candidate["tags"]
    if isinstance(candidate.get("text"), str) and candidate["text"]:
        out["text"] = candidate["text"]
    return out | {k: candidate[k] for k in ("limit", "timeout_ms") if isinstance(candidate.get(k), int | float) and not isinstance(candidate[k], bool)}
