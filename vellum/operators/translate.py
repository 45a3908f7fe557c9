"""The remote map: distinct texts in batches through a provider, with retries and halving."""

from __future__ import annotations

import html
import json
import time
import urllib.error
import urllib.request
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from vellum.config import BATCH_CHARS, BATCH_ITEMS, COOL_BUSY
from vellum.operators.packing import next_fit
from vellum.shared import written


class Failed(Exception):
    """A provider could not translate a batch."""


class Busy(Failed):
    """A provider asks for a rest."""


class Provider(Protocol):
    def translate(self, texts: list[str]) -> list[str]:
        """One reply for each text, or Failed. May be called again with the same texts."""


class Tagging:
    """For tests: puts the language before each text, and fails for texts of some lengths."""

    def __init__(self, lang: str, fails_at: int = 0):
        self.lang, self.fails_at = lang, fails_at

    def translate(self, texts: list[str]) -> list[str]:
        if self.fails_at and len(texts) == 1 and len(texts[0]) % self.fails_at == 0:
            raise Failed("length")
        if self.fails_at and any(len(t) % self.fails_at == 0 for t in texts):
            raise Failed("one of them")
        return [f"[{self.lang}] {t}" for t in texts]


class Fallback:
    """A provider, and another one for what it fails at: a few attempts with pauses, none while that one rests.

    A rest is known to the process that was told so; other workers find out themselves.
    """

    def __init__(self, first: Provider, second: Provider, attempts: int = 2, pause: float = 1.5, rest: float = COOL_BUSY):
        self.first, self.second, self.attempts, self.pause, self.rest, self.until = first, second, attempts, pause, rest, 0.0

    def translate(self, texts: list[str]) -> list[str]:
        try:
            return self.first.translate(texts)
        except Failed:
            pass
        for k in range(self.attempts):
            if time.monotonic() < self.until:
                break
            try:
                return self.second.translate(texts)
            except Busy:
                self.until = time.monotonic() + self.rest
            except Failed:
                time.sleep(self.pause * (k + 1))
        raise Failed("neither provider answered")


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """Status and body of a reply; other statuses than 200 are no error."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
            return reply.status, reply.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


class Http:
    """Workers' endpoints: posts text_list, lang and source, and takes as many texts back.

    attempts_made: what became of each call, (endpoint, seconds since 1970, ok, code, seconds). code: ok, secret
    (refused with 401), busy (429), status (any other), length (other than asked), reply (not understood), network.
    send: what posts, see post; another one may stand for it.
    """

    def __init__(self, urls: list[str], lang: str, secret: str = "", attempts: int = 5, pause: float = 0.3, timeout: float = 60, send=post):
        self.urls, self.lang, self.secret, self.attempts, self.pause, self.timeout, self.send = urls, lang, secret, attempts, pause, timeout, send
        self.attempts_made: list[tuple] = []

    def _ask(self, url: str, texts: list[str]) -> tuple[str, list[str]]:
        body = json.dumps({"text_list": texts, "lang": self.lang, "source": "auto"}).encode()
        try:
            status, said = self.send(f"{url}/translate", body, {"Content-Type": "application/json", "X-Worker-Key": self.secret}, self.timeout)
        except OSError:
            return "network", []
        if status != 200:
            return {401: "secret", 429: "busy"}.get(status, "status"), []
        try:
            found = json.loads(said)
            replies = found["translated"] if found.get("success") else None
        except (ValueError, KeyError, AttributeError):
            replies = None
        if not isinstance(replies, list):
            return "reply", []
        return ("ok", [html.unescape(str(t)) for t in replies]) if len(replies) == len(texts) else ("length", [])

    def translate(self, texts: list[str]) -> list[str]:
        codes = []
        for k in range(min(self.attempts, max(1, len(self.urls)))):
            url, began = self.urls[k % len(self.urls)], time.time()
            code, replies = self._ask(url, texts)
            self.attempts_made.append((url, began, code == "ok", code, time.time() - began))
            if code == "ok":
                return replies
            codes.append(code)
            time.sleep(self.pause * (k + 1))
        raise (Busy if set(codes) == {"busy"} else Failed)("all endpoints failed")


def halved(provider: Provider, texts: list[str], least: int = 4) -> list[str | None]:
    """Replies; a batch that fails is tried in halves down to least texts, and what fails even so is None."""
    try:
        return list(provider.translate(texts))
    except Failed:
        if len(texts) <= least:
            return [None] * len(texts)
        middle = len(texts) // 2
        return halved(provider, texts[:middle], least) + halved(provider, texts[middle:], least)


def run(unique: DataFrame, provider: Provider, body: str = "body", items: int = BATCH_ITEMS, chars: int = BATCH_CHARS, least: int = 4) -> DataFrame:
    """Adds translated to distinct texts: null where the provider failed, so that callers keep the text.

    Each Arrow batch of a partition is packed into requests by the limits. Tasks may run twice: providers must
    bear the same request again.
    """

    def part(frames):
        for frame in frames:
            yield frame.assign(translated=_replies(frame[body].tolist(), provider, items, chars, least))

    return unique.mapInPandas(part, StructType([*unique.schema.fields, StructField("translated", StringType())]))


def _replies(texts: list[str], provider: Provider, items: int, chars: int, least: int) -> list[str | None]:
    batch = next_fit([len(t) for t in texts], items, chars)
    out: list[str | None] = []
    for _, group in pd.Series(texts).groupby(batch, sort=True):
        out += halved(provider, group.tolist(), least)
    return out


ATTEMPT = "array<struct<endpoint:string,at:double,ok:boolean,code:string,latency:double>>"


def reported(unique: DataFrame, provider: Http, body: str = "body", items: int = BATCH_ITEMS, chars: int = BATCH_CHARS, least: int = 4) -> DataFrame:
    """As run, and attempts: the calls that were made for the texts of an Arrow batch, in the first of its rows."""

    def part(frames):
        for frame in frames:
            provider.attempts_made.clear()
            done = frame.assign(translated=_replies(frame[body].tolist(), provider, items, chars, least))
            made = [dict(zip(("endpoint", "at", "ok", "code", "latency"), a)) for a in provider.attempts_made]
            yield done.assign(attempts=[made if i == 0 else None for i in range(len(done))])

    return unique.mapInPandas(part, StructType([*unique.schema.fields, StructField("translated", StringType()), StructField("attempts", DataType.fromDDL(ATTEMPT))]))


def attempts(done: DataFrame) -> DataFrame:
    """(endpoint, id, ts, ok, code, latency): the calls of reported, as pings for service.ema and service.breaker."""
    made = done.select(F.inline("attempts"))
    moment = F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))
    return made.select("endpoint", F.xxhash64("endpoint", "at").alias("id"), moment.alias("ts"), "ok", "code", "latency")


def health(made: DataFrame) -> DataFrame:
    """(endpoint, calls, and a number for each way to fail, latency, fails, longest, trips) from the calls made."""
    from vellum.operators import service

    codes = ("secret", "busy", "status", "length", "reply", "network")
    counted = made.groupBy("endpoint").agg(F.count("*").alias("calls"), *[F.count_if(F.col("code") == c).alias(c) for c in codes])
    return counted.join(service.ema(made).drop("n"), "endpoint", "left").join(service.breaker(made), "endpoint", "left")


def finished(unique: DataFrame, provider: Provider, **how) -> DataFrame:
    """The replies of run, asked for once and kept in the shared folder; an error if there are texts but no reply at all."""
    done = written(run(unique, provider, **how))
    tally = done.agg(F.count("*").alias("n"), F.count("translated").alias("some")).first()
    if tally["n"] and not tally["some"]:
        raise Failed("no text could be translated")
    return done


def complete(done: DataFrame, column: str = "translated") -> DataFrame:
    """done, or an error when it is run and has texts but no reply at all."""
    tally = done.agg(F.count("*").alias("_all"), F.count(column).alias("_some"))
    none = (F.col("_all") > 0) & (F.col("_some") == 0)
    passed = tally.select(F.when(none, F.raise_error(F.lit("no text could be translated")).cast("boolean")).otherwise(True).alias("_ok"))
    return done.join(F.broadcast(passed)).where("_ok").drop("_ok")  # a frame of one row
