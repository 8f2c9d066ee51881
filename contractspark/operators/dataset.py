"""Training data from both origins: expert answers and generated examples, mixed, cleaned and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import render_chat, without_role
from ..rules import DEFAULT_RULES, EVAL_FRACTION, SPLIT_SEED, RuleSet
from ..session import shared_folder, staged
from .cleaning import clean_examples
from .qa import contract_examples, mix_datasets, qa_to_contracts
from .split import split_train_eval


def hybrid_dataset(
    synthetic: DataFrame, qa_rows: DataFrame, folder: str | None = None,
    fraction: float = EVAL_FRACTION, seed: int = SPLIT_SEED, rules: RuleSet = DEFAULT_RULES,
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) of the generated examples and the contracts of the expert answers, after cleaning.

    The cleaned mix is written once (to ``folder``, or a new path under the shared folder), so both parts
    and the cut between them read that table and nothing is parsed twice. Rows keep ``source`` and
    ``source_id``; either input may be empty.
    """
    mixed = mix_datasets(synthetic, contract_examples(qa_to_contracts(qa_rows)))
    spark = mixed.sparkSession
    cleaned = staged(clean_examples(mixed, rules), folder or shared_folder(spark, "hybrid"))
    return split_train_eval(cleaned, fraction, seed)


def evaluation_prompts(examples: DataFrame) -> DataFrame:
    """``example_id, prompt``: the messages without the answer, up to the header the model replies after."""
    return examples.select("example_id", prompt_of(F.col("messages")).alias("prompt"))


def prompt_of(messages: Column) -> Column:
    return render_chat(without_role(messages, "assistant"), add_reply_header=True)
