"""Gap-filling enrichment: a provider's answers fill what the parsers left open, and overwrite nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE_CHARS, SUMMARY_CHARS, MOST_ERRORS, TIMEOUT_S = 6000, 300, 3, 45

ANSWER = (
    "price_eur bigint, area_m2 double, rooms string, street string, district string, floor int, condition string, balcony boolean, "
    "parking boolean, terrace boolean, year_built int, is_new_development boolean, red_flags array<string>, summary string"
)


def source_text() -> Column:
    """What a provider is shown of a listing: title, snippet and raw values that aren't empty, joined by spaces."""
    parts = F.concat(F.array("title", "description_snippet"), F.map_values("raw"))
    return F.left(F.array_join(F.filter(parts, lambda v: v != ""), " "), F.lit(SOURCE_CHARS))


#: What a provider is asked for, in words and as a schema.
CONDITIONS = ["novostavba", "povodny_stav", "rekonstrukcia", "unknown"]
PROMPT = (
    "Read one Slovak real-estate listing of a flat in Bratislava and return the facts that its title and text state, as JSON of the given schema. "
    "What isn't stated is null; never guess. price_eur is the whole asking price in EUR, null where it is by agreement or only given per square metre. "
    "rooms is one of '1', '1.5', '2', '3', '4+'; district is 'Bratislava - <borough>' where it can be told; condition is one of " + ", ".join(CONDITIONS) + ". "
    "red_flags names auctions, co-ownership shares, tenants, liens and heavy renovation. summary is one or two sentences in English.\n"
)


def answer_schema() -> dict:
    """The JSON schema of an answer, from ANSWER's columns."""
    kinds = {"bigint": "integer", "int": "integer", "double": "number", "string": "string", "boolean": "boolean"}
    properties: dict[str, dict] = {}
    for field in ANSWER.split(", "):
        name, kind = field.split(" ")
        properties[name] = {"type": "array", "items": {"type": "string"}} if kind.startswith("array") else {"type": kinds[kind], "nullable": True}
    properties["condition"] = {"type": "string", "enum": CONDITIONS}
    properties["summary"] = {"type": "string"}
    return {"type": "object", "properties": properties, "required": ["summary"]}


def request(title: str, source: str) -> dict:
    """The body of a request for one listing."""
    text = f"{PROMPT}Title: {title}\nCard text: {source}\n"
    settings = {"responseMimeType": "application/json", "responseSchema": answer_schema(), "temperature": 0}
    return {"contents": [{"role": "user", "parts": [{"text": text}]}], "generationConfig": settings}


def answer_of(response: dict) -> str:
    """The JSON text of a provider's response; raises where there is none."""
    return response["candidates"][0]["content"]["parts"][0]["text"]


def http_provider(post: Callable, url: str, key: str) -> Callable[[str, str], str]:
    """A provider over post(url, json=, headers=, timeout=); the key goes in a header."""

    def provider(title: str, source: str) -> str:
        response = post(url, json=request(title, source), headers={"x-goog-api-key": key}, timeout=TIMEOUT_S)
        if response.status_code != 200:
            raise RuntimeError(f"HTTP {response.status_code}")
        return answer_of(response.json())

    return provider


def answers(listings: DataFrame, provider: Callable[[str, str], str] | None) -> DataFrame:
    """(id, json) for listings, from a provider; none without one. Rows come to the driver one partition at a time."""
    spark = listings.sparkSession
    if provider is None:
        return spark.createDataFrame([], "id string, json string")
    rows = ((r["id"], (r["title"], r["source"])) for r in listings.select("id", F.coalesce("title", F.lit("")).alias("title"), source_text().alias("source")).toLocalIterator())
    return spark.createDataFrame(ask(rows, lambda x: provider(*x)), "id string, json string")


def merge(listings: DataFrame, answers: DataFrame) -> DataFrame:
    """listings with gaps filled from answers (id, json), and the column ai with the extras.

    An answer that isn't an object, or whose fields have other types, fills nothing. Numbers must be above
    zero; a condition counts only where ours is unknown and the answer names a known one.
    """
    c = F.col
    read = answers.select("id", F.from_json("json", ANSWER).alias("a"))
    j = listings.join(read, "id", "left")
    positive = lambda x: F.when(x > 0, x)
    text = lambda x: F.when(x != "", x)
    named = F.when(c("a.condition").isin("novostavba", "povodny_stav", "rekonstrukcia"), c("a.condition"))
    flags = F.filter(c("a.red_flags"), lambda x: x.isNotNull() & (x != ""))
    ai = F.struct(
        c("a.parking").alias("parking"), c("a.terrace").alias("terrace"), c("a.year_built").alias("year_built"), c("a.is_new_development").alias("is_new_development"),
        flags.alias("red_flags"), F.left(F.trim(c("a.summary")), F.lit(SUMMARY_CHARS)).alias("summary"),
    )
    return j.withColumns(
        {
            "price_eur": F.coalesce("price_eur", positive(c("a.price_eur"))),
            "area_m2": F.coalesce("area_m2", positive(c("a.area_m2"))),
            "rooms": F.coalesce("rooms", text(c("a.rooms"))),
            "street": F.coalesce("street", text(c("a.street"))),
            "district": F.coalesce("district", text(c("a.district"))),
            "floor": F.coalesce("floor", c("a.floor")),
            "condition": F.when(c("condition") == "unknown", F.coalesce(named, c("condition"))).otherwise(c("condition")),
            "balcony": F.coalesce("balcony", c("a.balcony")),
            "ai": F.when(c("a").isNotNull(), ai),
        }
    ).drop("a")


def ask(rows: Iterable[tuple[str, object]], provider: Callable[[object], str], most_errors: int = MOST_ERRORS) -> list[tuple[str, str]]:
    """(id, json) for (id, source text) from a provider, one by one on the driver, as providers limit rates; stops
    after so many errors."""
    out, errors = [], 0
    for id_, text in rows:
        if errors >= most_errors:
            break
        try:
            out.append((id_, provider(text)))
        except Exception:  # noqa: BLE001  whatever a provider raises counts as one error
            errors += 1
    return out
