"""Pages of a wiki's web API: titles by name and by category, and a snapshot of their rendered text at a fixed revision.

An ``ask`` function sends one query and gives the answer as an object; ``wiki`` makes one that is polite over HTTP. Everything
else is written against ``ask``, so it runs on a fixture where there is no network. The service wants one request at a time, so
this is a small serial job on the driver; what it saves is read with ``readers.snapshot_pages``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from glossaflow.sources.readers import polite

Ask = Callable[..., dict]
# The most members of a category that one query gives, the least seconds between queries, and the lag accepted.
MEMBERS, LEAST_DELAY, LAG = 500, 0.5, 5
SNAPSHOT = "page-snapshot-1"


def wiki(edition: str, agent: str, *, delay: float = LEAST_DELAY, timeout: float = 30.0) -> Ask:
    """An ``ask`` for an edition ('el', 'zh-min-nan'); the agent must say who asks. Refuses bad settings (ValueError)."""
    if not re.fullmatch("[a-z][a-z0-9-]{0,29}", edition):
        raise ValueError(f"no edition: {edition!r}")
    if not agent.strip() or not agent.isprintable():
        raise ValueError("the agent must name who asks, in one line")
    if delay < LEAST_DELAY:
        raise ValueError(f"a delay under {LEAST_DELAY} s is impolite")
    last = [-delay]

    def send(url: str) -> tuple[int, dict, dict]:
        time.sleep(max(0.0, last[0] + delay - time.monotonic()))
        last[0] = time.monotonic()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "application/json"}), timeout=timeout) as reply:
                return reply.status, dict(reply.headers), json.load(reply)
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers or {}), {}

    def ask(**query) -> dict:
        given = urllib.parse.urlencode(query | {"format": "json", "formatversion": 2, "maxlag": LAG})
        return polite(lambda: send(f"https://{edition}.wikipedia.org/w/api.php?{given}"), sleep=time.sleep)

    return ask


def members(ask: Ask, category: str, limit: int) -> Iterator[str]:
    """Up to ``limit`` titles of the articles directly in a category, page by page."""
    given, rest = 0, {}
    while given < limit:
        answer = ask(action="query", list="categorymembers", cmtitle=category, cmnamespace=0, cmtype="page", cmsort="sortkey", cmdir="asc", cmlimit=min(MEMBERS, limit - given), **rest)
        for row in answer["query"]["categorymembers"][: limit - given]:
            given += 1
            yield row["title"]
        rest = answer.get("continue")
        if not rest:
            return


def wanted_titles(ask: Ask, titles: Sequence[str], categories: Sequence[str], most: int) -> list[str]:
    """Given titles in order, then those of the categories, each once, ``most`` at the most."""
    found = dict.fromkeys(list(dict.fromkeys(titles))[:most])
    for category in categories:
        if len(found) >= most:
            break
        for title in members(ask, category, most):
            if len(found) < most:
                found.setdefault(title)
    return list(found)


def why_skipped(page: dict, seen: set[int]) -> str | None:
    """Why a resolved page is left out; None if it is read."""
    rules = (
        ("missing_or_invalid", lambda: "missing" in page or "invalid" in page), ("non_article_namespace", lambda: page.get("ns") != 0),
        ("disambiguation", lambda: "disambiguation" in page.get("pageprops", {})), ("duplicate_resolved_page", lambda: page["pageid"] in seen),
    )
    return next((reason for reason, holds in rules if holds()), None)


def page_links(edition: str, title: str, revision: int) -> dict[str, str]:
    """Addresses of an article, of one of its revisions and of its history."""
    base = f"https://{edition}.wikipedia.org"
    return {
        "article_url": f"{base}/wiki/{urllib.parse.quote(title.replace(' ', '_'), safe='')}", "revision_url": f"{base}/w/index.php?oldid={revision}",
        "history_url": f"{base}/w/index.php?{urllib.parse.urlencode({'title': title, 'action': 'history'})}",
    }


def snapshot(ask: Ask, edition: str, titles: Sequence[str], categories: Sequence[str] = (), most: int = 20) -> dict:
    """The rendered pages at their present revisions, with where they come from and which titles were skipped.

    Refuses to start without titles, with empty ones or with '|' in one (ValueError), and to go on if the service shows another
    page or revision than it was asked for (RuntimeError), as a snapshot with gaps is worse than none.
    """
    if most < 1 or not (titles or categories) or any(not t.strip() or "|" in t for t in (*titles, *categories)):
        raise ValueError("name at least one title or category, each without '|', and at least one page")
    site = ask(action="query", meta="siteinfo", siprop="general|rightsinfo")["query"]
    resolved, pages, skipped, seen = wanted_titles(ask, titles, categories, most), [], [], set()
    for title in resolved:
        page = ask(action="query", titles=title, redirects=1, prop="info|revisions|pageprops", rvprop="ids|timestamp")["query"]["pages"][0]
        if reason := why_skipped(page, seen):
            skipped.append({"requested_title": title, "reason": reason})
            continue
        seen.add(page["pageid"])
        revision = (page.get("revisions") or [{}])[0]
        if "revid" not in revision:
            raise RuntimeError(f"no revision of {title!r} can be seen")
        shown = ask(action="parse", oldid=revision["revid"], prop="text|revid", disableeditsection=1, disabletoc=1)["parse"]
        if (shown.get("revid"), shown.get("pageid")) != (revision["revid"], page["pageid"]) or not isinstance(shown["text"], str):
            raise RuntimeError(f"another page or revision than asked for: {title!r}")
        own = {"requested_title": title, "title": page["title"], "page_id": page["pageid"], "revision_id": revision["revid"], "revision_timestamp": revision["timestamp"]}
        pages.append(own | page_links(edition, page["title"], revision["revid"]) | {"html": shown["text"], "html_sha256": hashlib.sha256(shown["text"].encode()).hexdigest()})
    return {
        "schema": SNAPSHOT, "edition": edition, "language": site["general"].get("lang", edition), "retrieved_at": dt.datetime.now(dt.timezone.utc).isoformat(), "rights_info": site.get("rightsinfo", {}),
        "selection": {"titles": list(titles), "categories": list(categories), "max_pages": most, "resolved": resolved}, "pages": pages, "skipped": skipped,
    }
