"""Topic, expression and sentiment labels from rule tables.

Rules are folded into one expression per event, so classification is a projection: no join with the
rule table, no shuffle, and one pass over the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.text import contains_all, contains_any, hit_count, is_blank, longest_hit
from tallyvox.session import materialize
from tallyvox.sources import fixed_rules as fixed
from tallyvox.sources.rule_tables import EXPRESSION_RULES, TOPIC_RULES, Rule

MAX_TOPICS = 2
LABEL_MODEL_EXPRESSIONS = ["expr_complaint", "expr_suggestion"]


@dataclass(frozen=True)
class Lexicon:
    """Words that locate a topic in a text and words that give it a polarity."""

    topic_words: list[tuple[list[str], list[str]]] = field(default_factory=lambda: fixed.TOPIC_WORDS)
    positive: list[str] = field(default_factory=lambda: fixed.POSITIVE_WORDS)
    negative: list[str] = field(default_factory=lambda: fixed.NEGATIVE_WORDS)
    contrast_long: str = fixed.CONTRAST_LONG
    contrast_short: str = fixed.CONTRAST_SHORT
    before: int = 12
    after: int = 16


def candidates(text: Column, rules: list[Rule], hit_order: str = "asc") -> Column:
    """Matching rules, best first: priority down, hits, longest hit, rule position.

    `hit_order="asc"` is the order results are compared with (fewer hits first, longer hit first);
    "desc" prefers more hits.
    """
    if hit_order not in ("asc", "desc"):
        raise ValueError(hit_order)
    found = []
    for position, rule in enumerate(rules):
        hits = hit_count(text, rule.any_patterns)
        matches = (
            ~contains_any(text, rule.exclude_patterns)
            & (hits > 0)
            & contains_all(text, rule.all_patterns)
        )
        found.append(
            F.when(
                matches,
                F.struct(
                    F.lit(-rule.priority).alias("rank_priority"),
                    (hits if hit_order == "asc" else -hits).alias("rank_hits"),
                    (-longest_hit(text, rule.any_patterns)).alias("rank_longest"),
                    F.lit(position).alias("rule_pos"),
                    F.lit(rule.canonical_key).alias("canonical_key"),
                ),
            )
        )
    return F.array_sort(F.array_compact(F.array(*found)))


def is_tied(found: Column) -> Column:
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    return (
        (F.size(found) > 1)
        & (first["rank_priority"] == second["rank_priority"])
        & (first["rank_hits"] == second["rank_hits"])
    )


def with_topic_candidates(
    events: DataFrame, rules: list[Rule] = TOPIC_RULES, hit_order: str = "asc"
) -> DataFrame:
    text = F.coalesce(F.col("normalized_text"), F.lit(""))
    return events.withColumn("_topics", candidates(text, rules, hit_order))


def labels_of(found: Column) -> Column:
    tied = is_tied(found)
    return F.transform(
        F.slice(found, 1, MAX_TOPICS),
        lambda c, i: F.struct(
            c["canonical_key"].alias("canonical_key"),
            F.when((i == 1) & tied, F.lit(0.5)).otherwise(F.lit(1.0)).alias("confidence"),
            F.when((i == 1) & tied, F.lit("ambiguous")).otherwise(F.lit("rule")).alias("method"),
            (i + 1).cast("int").alias("rank"),
        ),
    )


def topic_classify(
    events: DataFrame, rules: list[Rule] = TOPIC_RULES, hit_order: str = "asc"
) -> DataFrame:
    found = with_topic_candidates(events, rules, hit_order)
    # An outer generator: Spark would push the filter it infers for a plain one down to the texts
    # and evaluate every rule twice.
    listed = found.select("event_id", F.inline_outer(labels_of(F.col("_topics"))))
    return listed.filter(F.col("canonical_key").isNotNull())


def review_reason(events: DataFrame, rules: list[Rule] = TOPIC_RULES) -> DataFrame:
    found = F.col("_topics")
    reason = F.when(is_tied(found), F.lit("ambiguous_topics")).when(
        F.size(found) > MAX_TOPICS, F.lit("too_many_topics")
    )
    return with_topic_candidates(events, rules).select("event_id", reason.alias("reason"))


def general_fallback(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events without a label get the general topic."""
    unlabelled = events.select("event_id").join(labels, "event_id", "left_anti")
    general = unlabelled.select(
        "event_id",
        F.lit(fixed.GENERAL_TOPIC).alias("canonical_key"),
        F.lit(1.0).alias("confidence"),
        F.lit("general").alias("method"),
        F.lit(1).alias("rank"),
    )
    return labels.unionByName(general)


def model_label_merge(
    events: DataFrame,
    labels: DataFrame,
    expressions: DataFrame,
    scored: DataFrame,
    topic_keys: list[str],
    min_len: int = 15,
    min_conf: float = 0.7,
) -> DataFrame:
    """Externally scored labels for events that no rule labelled; every attempt is kept.

    Accepted attempts become labels with method `llm`, the others fall back to the general topic.
    """
    labels = materialize(labels)  # read twice
    # Only the length of a text is needed: no text is shuffled.
    lengths = events.select("event_id", F.length("normalized_text").alias("_length"))
    unlabelled = lengths.join(labels, "event_id", "left_anti")
    asked = F.col("expression").isin(LABEL_MODEL_EXPRESSIONS) & (F.col("_length") >= min_len)
    allowed = [k for k in topic_keys if k != fixed.GENERAL_TOPIC]
    attempts = (
        unlabelled.join(expressions.select("event_id", "expression"), "event_id", "left")
        .join(scored.select("event_id", "scored_key", "scored_confidence"), "event_id", "left")
        .withColumn(
            "accepted",
            F.when(
                asked & F.col("scored_key").isNotNull(),
                (F.col("scored_confidence") >= min_conf) & F.col("scored_key").isin(allowed),
            ),
        )
    )
    taken = F.coalesce("accepted", F.lit(False))
    merged = attempts.select(
        "event_id",
        F.when(taken, F.col("scored_key")).otherwise(fixed.GENERAL_TOPIC).alias("canonical_key"),
        F.when(taken, F.col("scored_confidence")).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(taken, F.lit("llm")).otherwise(F.lit("general")).alias("method"),
        F.lit(1).alias("rank"),
        "accepted",
    )
    return labels.withColumn("accepted", F.lit(None).cast("boolean")).unionByName(merged)


def expression_columns(
    text: Column, rules: list[Rule] = EXPRESSION_RULES, hit_order: str = "asc"
) -> Column:
    found = candidates(F.coalesce(text, F.lit("")), rules, hit_order)
    none = is_blank(text) | (F.size(found) == 0)
    mixed = ~none & is_tied(found)
    return F.struct(
        F.when(none, F.lit(fixed.OTHER_EXPRESSION))
        .otherwise(F.get(found, F.lit(0))["canonical_key"])
        .alias("expression"),
        F.when(mixed, F.lit(0.5)).otherwise(F.lit(1.0)).alias("confidence"),
        mixed.alias("mixed"),
    )


def expression_classify(
    events: DataFrame, rules: list[Rule] = EXPRESSION_RULES, hit_order: str = "asc"
) -> DataFrame:
    return events.select(
        "event_id", expression_columns(F.col("normalized_text"), rules, hit_order).alias("e")
    ).select("event_id", "e.expression", "e.confidence", "e.mixed")


def sentiment_of(text: Column, lexicon: Lexicon) -> Column:
    good, bad = contains_any(text, lexicon.positive), contains_any(text, lexicon.negative)
    return (
        F.when(good & bad, F.lit("mixed"))
        .when(good, F.lit("positive"))
        .when(bad, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def with_sentiments(
    df: DataFrame, keys_to_names: dict[str, str], lexicon: Lexicon, text: str = "normalized_text"
) -> DataFrame:
    """Adds the sentiment of each topic key column, null where the key is null.

    A topic with located words is judged on their neighbourhood, cut at the nearest contrast words,
    every other topic on the whole text. Built in steps so that positions are computed once.
    """
    t, short, long = F.col(text), lexicon.contrast_short, lexicon.contrast_long
    at, head, prev, nxt, win = ({k: f"_{n}_{k}" for k in keys_to_names} for n in ("at", "head", "prev", "next", "win"))

    def located(key: str) -> Column:
        result = F.lit(None).cast("int")
        for topic_keys, words in lexicon.topic_words:
            places = F.array(*[F.nullif(F.instr(t, w), F.lit(0)) for w in words])
            result = F.when(F.col(key).isin(topic_keys), F.array_min(places) - 1).otherwise(result)
        return result

    rows = df.withColumns({at[k]: located(k) for k in keys_to_names})
    rows = rows.withColumns(
        {
            **{head[k]: F.substring(t, F.lit(1), F.col(at[k]) + len(short)) for k in keys_to_names},
            **{
                nxt[k]: F.nullif(F.locate(short, F.substring(t, F.col(at[k]) + 1, F.length(t))), F.lit(0)) - 1
                for k in keys_to_names
            },
        }
    )
    rows = rows.withColumns(
        {
            prev[k]: F.length(head[k])
            - F.nullif(F.instr(F.reverse(head[k]), short[::-1]), F.lit(0))
            - len(short)
            + 1
            for k in keys_to_names
        }
    )

    def window(k: str) -> Column:
        a, p, n = F.col(at[k]), F.col(prev[k]), F.col(nxt[k])
        skip = F.when(F.substring(t, p + 1, F.lit(len(long))) == long, F.lit(len(long))).otherwise(
            F.lit(len(short))
        )
        start = F.greatest(F.lit(0), a - lexicon.before, p + skip)
        end = F.least(F.length(t), a + lexicon.after, a + n)
        return F.when(a.isNull(), t).otherwise(F.substring(t, start + 1, end - start))

    rows = rows.withColumns({win[k]: window(k) for k in keys_to_names})
    rows = rows.withColumns(
        {
            name: F.when(F.col(k).isNotNull(), sentiment_of(F.col(win[k]), lexicon))
            for k, name in keys_to_names.items()
        }
    )
    return rows.drop(*[names[k] for names in (at, head, prev, nxt, win) for k in keys_to_names])


def topic_sentiment(events: DataFrame, labels: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    rows = labels.select("event_id", "canonical_key").join(
        events.select("event_id", "normalized_text").filter(~is_blank(F.col("normalized_text"))), "event_id"
    )
    judged = with_sentiments(rows, {"canonical_key": "sentiment"}, lexicon or Lexicon())
    return judged.select("event_id", "canonical_key", "sentiment")


def issue_links(labels: DataFrame, sentiments: DataFrame) -> DataFrame:
    return labels.join(sentiments, ["event_id", "canonical_key"], "left").select(
        "event_id",
        "canonical_key",
        "rank",
        "method",
        "confidence",
        F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"),
    ).dropDuplicates(["event_id", "canonical_key"])


def review_candidates(links: DataFrame, reasons: DataFrame) -> DataFrame:
    """Event-level reasons first, then mixed or ambiguous links; one row per event and reason."""
    first_label = (
        links.filter(F.col("rank") == 1)
        .groupBy("event_id")
        .agg(
            F.min("canonical_key").alias("suggested_key"),
            F.min_by("sentiment", "canonical_key").alias("suggested_sentiment"),
        )
    )
    by_event = (
        reasons.filter(F.col("reason").isNotNull())
        .join(first_label, "event_id", "left")
        .select(
            "event_id",
            F.col("reason").alias("reason_code"),
            "suggested_key",
            "suggested_sentiment",
            F.lit(0).alias("_order"),
        )
    )
    by_link = links.filter(
        (F.col("sentiment") == "mixed") | (F.col("method") == "ambiguous")
    ).select(
        "event_id",
        F.when(F.col("sentiment") == "mixed", F.lit("mixed_sentiment"))
        .otherwise(F.lit("ambiguous_topics"))
        .alias("reason_code"),
        F.col("canonical_key").alias("suggested_key"),
        F.col("sentiment").alias("suggested_sentiment"),
        F.col("rank").alias("_order"),
    )
    order = Window.partitionBy("event_id", "reason_code").orderBy("_order", "suggested_key")
    return (
        by_event.unionByName(by_link)
        .withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .drop("_n", "_order")
    )


def classify_events(
    events: DataFrame,
    topics: list[Rule] = TOPIC_RULES,
    expressions: list[Rule] = EXPRESSION_RULES,
    lexicon: Lexicon | None = None,
    hit_order: str = "asc",
) -> DataFrame:
    """All labels of an event in one pass: topics with sentiment, expression, review reason.

    No join and no shuffle: `labels` is an array of at most two topics per event, the general topic
    where no rule matches. `normalized_text` must already be normalized.
    """
    rows = with_topic_candidates(events, topics, hit_order)
    found = F.col("_topics")
    none = F.size(found) == 0
    key = lambda i: F.get(found, F.lit(i))["canonical_key"]
    rows = rows.withColumns(
        {
            "_key1": F.when(none, F.lit(fixed.GENERAL_TOPIC)).otherwise(key(0)),
            "_key2": key(1),
            "_none": none,
            "_tie": is_tied(found),
            "reason": F.when(is_tied(found), F.lit("ambiguous_topics")).when(
                F.size(found) > MAX_TOPICS, F.lit("too_many_topics")
            ),
        }
    )
    rows = with_sentiments(rows, {"_key1": "_s1", "_key2": "_s2"}, lexicon or Lexicon())
    neutral = lambda c: F.when(is_blank(F.col("normalized_text")), F.lit("neutral")).otherwise(F.col(c))

    def label(k: str, sentiment: str, rank: int, method: Column, confidence: Column) -> Column:
        return F.struct(
            F.col(k).alias("canonical_key"),
            confidence.alias("confidence"),
            method.alias("method"),
            F.lit(rank).alias("rank"),
            neutral(sentiment).alias("sentiment"),
        )

    first = label(
        "_key1", "_s1", 1, F.when(F.col("_none"), F.lit("general")).otherwise(F.lit("rule")), F.lit(1.0)
    )
    tied = F.col("_tie")
    second = label(
        "_key2",
        "_s2",
        2,
        F.when(tied, F.lit("ambiguous")).otherwise(F.lit("rule")),
        F.when(tied, F.lit(0.5)).otherwise(F.lit(1.0)),
    )
    return rows.select(
        *[F.col(c) for c in events.columns],
        F.array_compact(F.array(first, F.when(F.col("_key2").isNotNull(), second))).alias("labels"),
        "reason",
        expression_columns(F.col("normalized_text"), expressions, hit_order).alias("_e"),
    ).select(
        *events.columns,
        "labels",
        "reason",
        "_e.expression",
        F.col("_e.confidence").alias("expression_confidence"),
        "_e.mixed",
    )


def classified_links(classified: DataFrame) -> DataFrame:
    """One row per event and label."""
    kept = [c for c in ("ws", "event_id", "occurred_at", "source_kind") if c in classified.columns]
    return classified.select(*kept, F.inline_outer("labels"))


def classified_reviews(classified: DataFrame) -> DataFrame:
    """Review candidates of classified events: one event is one row, so nothing is shuffled."""
    review = lambda code, x: F.struct(
        code.alias("reason_code"),
        x["canonical_key"].alias("suggested_key"),
        x["sentiment"].alias("suggested_sentiment"),
    )
    first = F.get("labels", F.lit(0))
    by_event = F.when(F.col("reason").isNotNull(), review(F.col("reason"), first))
    by_link = F.transform(
        "labels",
        lambda x: F.when(x["sentiment"] == "mixed", review(F.lit("mixed_sentiment"), x)).when(
            x["method"] == "ambiguous", review(F.lit("ambiguous_topics"), x)
        ),
    )
    found = classified.withColumn("_r", F.array_compact(F.concat(F.array(by_event), by_link)))
    once = F.filter(
        "_r",
        lambda x, i: F.array_position(F.transform("_r", lambda y: y["reason_code"]), x["reason_code"])
        == i + 1,
    )
    listed = found.select("event_id", F.inline_outer(once))
    return listed.filter(F.col("reason_code").isNotNull())


def annotations(
    events: DataFrame,
    expressions: DataFrame,
    rule_version: str = fixed.EXPRESSION_VERSION,
    pack_version: str = fixed.DEFAULT_PACK_VERSION,
) -> DataFrame:
    """One row per event; an event without an expression label stops the job when it is read."""
    joined = events.join(expressions, "event_id", "left")
    label = F.when(F.col("expression").isNotNull(), F.col("expression")).otherwise(
        F.raise_error(F.concat(F.lit("event without expression label: "), F.col("event_id")))
    )
    return joined.select(
        "ws",
        "event_id",
        "occurred_at",
        label.alias("expression"),
        "confidence",
        "mixed",
        F.lit(rule_version).alias("rule_version"),
        F.lit(pack_version).alias("pack_version"),
    )
