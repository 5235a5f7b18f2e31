"""What candle services are asked, as data: a client given by the caller sends it.

Dates are whole days. Paths, fields and values are those of the services'
public interfaces.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode

# Paths of the services' interfaces.
INTRADAY = "/v2/charts/intraday"
MASTER = "/v2/instrument/{segment}"
HISTORY = "/v3/historical-candle/{key}/{unit}/{interval}/{last}/{first}"
EXPIRED_HISTORY = "/v2/expired-instruments/historical-candle/{key}/{interval}/{last}/{first}"
EXPIRED_CONTRACTS = "/v2/expired-instruments/future/contract"


@dataclass(frozen=True)
class Request:
    """Method, path with query, and the body of a POST."""

    method: str
    path: str
    body: Mapping = field(default_factory=dict)


def _day(day: dt.date | str) -> str:
    return day if isinstance(day, str) else day.isoformat()


def intraday(security_id, first, last, segment: str = "NSE_FNO", instrument_type: str = "FUTIDX", interval: str = "1", open_interest: bool = True) -> Request:
    """Candles of one contract between two days, both included."""
    named = {"securityId": str(security_id), "exchangeSegment": segment, "instrument": instrument_type, "interval": str(interval)}
    return Request("POST", INTRADAY, named | {"oi": json.dumps(bool(open_interest)), "fromDate": _day(first), "toDate": _day(last)})


def history(key: str, first, last, unit: str = "minutes", interval: int = 1) -> Request:
    """Candles of an active contract; the later day comes first in the path."""
    return Request("GET", HISTORY.format(key=quote(key, safe=""), unit=unit, interval=interval, first=_day(first), last=_day(last)))


def expired_history(key: str, first, last, interval: str = "1minute") -> Request:
    return Request("GET", EXPIRED_HISTORY.format(key=quote(key, safe=""), interval=interval, first=_day(first), last=_day(last)))


def expired_contracts(underlying: str, expiry) -> Request:
    return Request("GET", f"{EXPIRED_CONTRACTS}?{urlencode({'instrument_key': underlying, 'expiry_date': _day(expiry)})}")


KINDS: dict[str, Callable[..., Request]] = {"intraday": intraday, "history": history, "expired_history": expired_history}


def spans(first: dt.date, last: dt.date, days: int) -> Iterator[tuple[dt.date, dt.date]]:
    """The days from ``first`` to ``last`` in spans of at most ``days``, one for each request."""
    for offset in range(0, (last - first).days + 1, days):
        start = first + dt.timedelta(days=offset)
        yield start, min(start + dt.timedelta(days=days - 1), last)


def payload_rows(status: int, text: str) -> list:
    """The candle rows of an answer: a list, or a record with data.candles; an error status raises RuntimeError."""
    if status >= 400:
        raise RuntimeError(f"the service answered {status}: {text[:300]}")
    answer = json.loads(text) if text.strip() else []
    if isinstance(answer, Mapping):
        answer = (answer.get("data") or {}).get("candles") or []
    return answer if isinstance(answer, list) else []


def master_text(get: Callable[[str], tuple[int, str]], urls: Sequence[str]) -> str:
    """The first of ``urls`` that answers, in order: the service's own, then the published copy. None that does raises RuntimeError."""
    failed = []
    for url in urls:
        try:
            status, text = get(url)
        except OSError as error:
            failed.append(f"{url}: {error}")
            continue
        if status < 400:
            return text
        failed.append(f"{url}: {status}")
    raise RuntimeError("; ".join(failed) or "no address given")
