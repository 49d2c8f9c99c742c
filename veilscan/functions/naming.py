"""Environment variable names for rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule name to environment variable name.
ENV_NAMES = {
    "AWS_ACCESS_KEY": "AWS_ACCESS_KEY_ID",
    "AWS_SECRET_KEY": "AWS_SECRET_ACCESS_KEY",
    "OPENAI_API_KEY": "OPENAI_API_KEY",
    "ANTHROPIC_API_KEY": "ANTHROPIC_API_KEY",
    "GITHUB_TOKEN": "GITHUB_TOKEN",
    "SLACK_WEBHOOK": "SLACK_WEBHOOK_URL",
    "DISCORD_WEBHOOK": "DISCORD_WEBHOOK_URL",
    "DATABASE_URL": "DATABASE_URL",
    "POSTGRES_PASSWORD": "POSTGRES_PASSWORD",
    "MYSQL_PASSWORD": "MYSQL_PASSWORD",
    "REDIS_PASSWORD": "REDIS_PASSWORD",
    "JWT_SECRET": "JWT_SECRET_KEY",
    "API_KEY": "API_KEY",
    "API_SECRET": "API_SECRET",
}
# A name holding one of these needs no suffix.
SELF_EXPLAINING = ["KEY", "TOKEN", "SECRET", "PASSWORD"]


def default_env_name(rule: str) -> str:
    """The name for a rule's first finding, for texts made on the driver."""
    base = rule.upper().replace("-", "_").replace(" ", "_")
    plain = base if any(w in base for w in SELF_EXPLAINING) else base + "_KEY"
    return ENV_NAMES.get(base, plain)


def env_var_name(rule: Column, ordinal: Column | int = 0) -> Column:
    """Variable name for the ``ordinal``-th (0-based) finding of a rule."""
    base = F.translate(F.upper(rule), "- ", "__")
    known = F.create_map(*[F.lit(x) for pair in ENV_NAMES.items() for x in pair])
    plain = F.when(base.rlike("|".join(SELF_EXPLAINING)), base).otherwise(F.concat(base, F.lit("_KEY")))
    name = F.coalesce(known[base], plain)
    n = F.lit(ordinal) if isinstance(ordinal, int) else ordinal
    return F.when(n > 0, F.concat(name, F.lit("_"), (n + 1).cast("string"))).otherwise(name)
