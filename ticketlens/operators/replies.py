"""Reply examples: prompts, template replies and a pluggable text generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.parse import to_text
from ticketlens.functions.text import reply_prompt, shorten, template_reply
from ticketlens.operators.sample import sample_exact

# Sample size, seed, display width and mode names.
EXAMPLES = 6
SEED = 42
SHOWN_CHARS = 150
TEMPLATE_MODE = "template"
GENERATED_MODE = "generated"

# Loads a model once and returns a function from prompts to replies (None: no reply).
GeneratorLoader = Callable[[], Callable[[list[str]], list[str | None]]]


def with_generated(df: DataFrame, prompt: str, load: GeneratorLoader, into: str = "generated") -> DataFrame:
    """Adds the generator's reply to each prompt; ``load`` runs once per partition, and only prompts go to Python."""

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = load()
        for prompts in batches:
            yield pd.Series(generate(prompts.tolist()), index=prompts.index, dtype="object")

    # Not to be run again where the reply is used twice.
    return df.withColumn(into, reply.asNondeterministic()(prompt))


def reply_examples(
    tickets: DataFrame, key: str = "ticket_id", n: int | None = EXAMPLES, load: GeneratorLoader | None = None
) -> DataFrame:
    """Sampled tickets with shortened texts and a reply: generated if possible, else the template.

    Tickets need both texts, and a blank text is none.  ``n=None`` takes all of them.
    """
    usable = tickets.filter((to_text("agent_first_reply") != "") & (to_text("initial_message") != ""))
    chosen = usable if n is None else sample_exact(usable, n, key, SEED)
    rows = chosen.select(
        key,
        reply_prompt().alias("prompt"),
        shorten("initial_message", SHOWN_CHARS).alias("customer_message"),
        shorten("agent_first_reply", SHOWN_CHARS).alias("actual_reply"),
        template_reply().alias("_template"),
    )
    if load is None:
        rows = rows.withColumn("_generated", F.lit(None).cast("string"))
    else:
        rows = with_generated(rows, "prompt", load, "_generated")
    return rows.select(
        key, "prompt", "customer_message", "actual_reply",
        F.coalesce("_generated", "_template").alias("generated_reply"),
        F.when(F.col("_generated").isNull(), TEMPLATE_MODE).otherwise(GENERATED_MODE).alias("mode"),
    )


def example_lines(examples: DataFrame, key: str = "ticket_id") -> DataFrame:
    """One readable text per example."""
    return examples.select(
        F.concat_ws(
            "\n",
            F.concat(F.lit("--- Ticket "), F.col(key).cast("string"), F.lit(" ("), F.col("mode"), F.lit(") ---")),
            F.concat(F.lit("Customer: "), "customer_message"),
            F.concat(F.lit("Actual: "), "actual_reply"),
            F.concat(F.lit("Generated: "), "generated_reply"),
        ).alias("value")
    )
