"""Fetching of URLs behind a plain callable, so that tests and batch jobs bring their own transport."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import urljoin

from websift.functions.urls import clean


class Response(NamedTuple):
    status: int
    body: bytes = b""
    location: str | None = None


class Fetched(NamedTuple):
    """body, redirect or error: one of them is set."""

    body: bytes | None = None
    redirect: str | None = None
    error: str | None = None


Transport = Callable[[str], Response]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:
        return None


def http_transport(url: str, timeout: float = 30, max_length: int = 15_000_000) -> Response:
    try:
        with urllib.request.build_opener(_NoRedirect).open(url, timeout=timeout) as r:
            return Response(r.status, r.read(max_length))
    except urllib.error.HTTPError as e:
        return Response(e.code, b"", e.headers.get("Location"))


def redirect_location(url: str, location: str | None) -> str | None:
    """The cleaned absolute target; None if it is missing, bad or the URL itself."""
    target = clean(urljoin(url, location)) if location else None
    return None if target == url else target


def fetch(transport: Transport, url: str, max_length: int = 15_000_000) -> Fetched:
    """2xx: the body, cut at max_length. 3xx: the redirect. Everything else, and what the transport raises: an error."""
    try:
        r = transport(url)
    except Exception as e:
        return Fetched(error=str(e) or type(e).__name__)
    if 200 <= r.status < 300:
        return Fetched(body=r.body[:max_length])
    if 300 <= r.status < 400:
        target = redirect_location(url, r.location)
        return Fetched(redirect=target) if target else Fetched(error="bad redirect")
    return Fetched(error=f"status {r.status}")


def fetch_following(transport: Transport, url: str, hops: int = 5, max_length: int = 5_001_024) -> Fetched:
    got = Fetched(error="no hop left")
    for _ in range(hops):
        got = fetch(transport, url, max_length)
        if got.redirect is None:
            return got
        url = got.redirect
    return Fetched(error="too many redirects")
