"""CSV export under display headers."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Display header of each result column.
DISPLAY_NAMES = {
    "prompt": "Prompt",
    "response": "Response",
    "prompt_sentiment": "Prompt Sentiment",
    "response_sentiment": "Response Sentiment",
    "prompt_toxicity": "Prompt Toxicity",
    "response_toxicity": "Response Toxicity",
    "prompt_injection": "Injection Score",
    "prompt_jailbreak": "Jailbreak Score",
    "refusal": "Refusal Score",
    "prompt_topics": "Prompt Topics",
    "response_topics": "Response Topics",
    "prompt_patterns": "Prompt Patterns",
    "response_patterns": "Response Patterns",
    "prompt_pii": "Prompt Entities",
    "response_pii": "Response Entities",
}


def with_display_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: DISPLAY_NAMES[c] for c in df.columns if c in DISPLAY_NAMES})


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one CSV file per partition; quotes and newlines inside fields survive."""
    with_display_names(df).write.mode(mode).csv(path, header=True, escape='"', quoteAll=True)
