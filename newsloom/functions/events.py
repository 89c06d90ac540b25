"""Typed events by weighted key words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text

#: Event types in order, with key words (found anywhere, inside words too) and weights.
KEYWORDS = {
    "release_launch": (("launch", 0.20), ("launched", 0.20), ("launches", 0.20), ("release", 0.16), ("released", 0.16), ("ships", 0.18), ("ship", 0.16), ("debut", 0.16), ("announce", 0.14), ("announced", 0.14)),
    "funding": (("funding", 0.24), ("raise", 0.22), ("raises", 0.22), ("raised", 0.22), ("investment", 0.20), ("invests", 0.18), ("invested", 0.18), ("series a", 0.22), ("series b", 0.22), ("series c", 0.22), ("seed round", 0.20)),
    "partnership": (("partnership", 0.24), ("partner", 0.20), ("partners", 0.20), ("collaboration", 0.18), ("collaborate", 0.18), ("agreement", 0.16), ("allianc", 0.16)),
    "acquisition": (("acquire", 0.24), ("acquires", 0.24), ("acquired", 0.24), ("acquisition", 0.24), ("buy", 0.18), ("bought", 0.18), ("merger", 0.18)),
    "leadership_change": (("appoint", 0.20), ("appointed", 0.20), ("joins as", 0.20), ("named", 0.16), ("resign", 0.22), ("resigned", 0.22), ("steps down", 0.22), ("promote", 0.18)),
    "policy_regulation": (("policy", 0.20), ("regulation", 0.22), ("regulator", 0.20), ("bill", 0.18), ("law", 0.18), ("ban", 0.18), ("rules", 0.16), ("legal", 0.16)),
    "security_incident": (("breach", 0.24), ("hack", 0.22), ("hacked", 0.22), ("vulnerability", 0.20), ("incident", 0.18), ("outage", 0.18), ("leak", 0.18), ("attack", 0.18), ("exploit", 0.18)),
}


def best_event(head: Column, rest: Column) -> Column:
    """struct<less, event_type, score> of the best event, or null: hits in the normalised title count in full, in the body 0.6.

    less is the confidence with its sign changed, so that the least struct is the best event.
    """

    def points(word: str, weight: float) -> Column:
        in_head, in_rest, bonus = head.contains(word), rest.contains(word), 0.02 if " " not in word and len(word) >= 5 else 0.0
        return F.when(in_head, weight).otherwise(0.0) + F.when(in_rest, weight * 0.6).otherwise(0.0) + F.when(in_head | in_rest, bonus).otherwise(0.0)

    scored = []
    for kind, words in KEYWORDS.items():
        total = F.lit(0.0)
        for word, weight in words:
            total = total + points(word, weight)
        scored.append(F.struct(F.lit(kind).alias("event_type"), F.round(total, 6).alias("points"), (head != "").alias("headed")))
    finished = F.transform(F.array(*scored), lambda e: F.struct(e["event_type"].alias("event_type"), (e["points"] + F.when(e["headed"] & (e["points"] > 0), 0.04).otherwise(0.0)).alias("score")))
    kept = F.transform(F.filter(finished, lambda e: e["score"] >= 0.15), lambda e: F.struct((-F.round(F.least(F.lit(0.99), 0.45 + e["score"]), 3)).alias("less"), e["event_type"].alias("event_type"), e["score"].alias("score")))
    return F.array_min(kept)


def event_key(kind: Column, title: Column, body: Column) -> Column:
    name = F.when(F.trim(title) != "", F.substring(F.trim(title), 1, 180)).otherwise(F.substring(text.first_sentence(body), 1, 180))
    return text.normalize(F.concat_ws(" ", kind, name))
