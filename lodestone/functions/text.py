"""Text and code tests as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default keyword list.
KEYWORDS = [
    "gaf", "gramian", "gramian_angular", "gasf", "gadf", "mtf", "recurrence", "ta-lib", "talib", "ta.lib", "TA_", "backtrader", "bt.", "zipline",
    "vectorbt", "pandas_ta", "finta", "pyti", "tulipy", "stable_baselines", "sb3", "gym", "gymnasium", "env.step", "reward", "policy", "agent",
    "q_learning", "dqn", "ppo", "a2c", "sharpe", "sortino", "max_drawdown", "var", "cvar", "volatility", "alpha", "beta", "kelly", "position_size",
    "risk_parity", "ohlcv", "candlestick", "ticker", "yfinance", "ccxt", "binance", "signal", "indicator", "macd", "rsi", "bollinger", "ema", "sma",
    "backtest", "strategy", "portfolio", "execution", "slippage", "order", "fill", "pnl", "equity_curve", "trade_log", "pyts", "tsfresh", "tslearn",
    "prophet", "arima", "garch",
]
# The shorter list of the light filter; its words are patterns as they stand.
LIGHT = [
    "gaf", "gramian", "gasf", "gadf", "mtf", "talib", "ta-lib", "backtrader", "zipline", "vectorbt", "sharpe", "sortino", "drawdown", "volatility",
    "signal", "indicator", "macd", "rsi", "bollinger", "ema", "sma", "backtest", "strategy", "portfolio", "position_size", "yfinance", "ccxt",
    "ohlcv", "candlestick", "gymnasium", "gym", "stable_baselines", "reward", "agent", "pyts", "tsfresh", "prophet",
]
# The patterns of high value.
HIGH_VALUE = [
    r"gramian[_\s]?angular", r"GramianAngularField", r"GASF|GADF|MTF", r"pyts\.image",
    r"class\s+\w*Strategy\w*", r"class\s+\w*Backtest\w*", r"def\s+next\s*\(\s*self",
    r"def\s+(calculate_|compute_|get_)(signal|indicator|position)", r"def\s+on_(data|bar|tick|trade)",
    r"class\s+\w*TradingEnv\w*", r"env\.step\s*\(", r"self\.observation_space",
    r"sharpe[_\s]?ratio", r"sortino[_\s]?ratio", r"max[_\s]?drawdown", r"position[_\s]?size",
]
# Libraries whose imports are recognised, and marks of generated files.
IMPORTS = ["talib", "backtrader", "zipline", "pandas_ta", "vectorbt", "pyts", "yfinance", "ccxt", "stable_baselines", "gymnasium", "gym"]
GENERATED = ["auto-generated", "autogenerated", "do not edit", "generated by", "this file was generated"]

# The characters that a line without content consists of.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"


def words_pattern(word: str) -> str:
    """The word, case aside, between word boundaries."""
    return rf"(?i)\b{re.sub(r'([^A-Za-z0-9_])', lambda m: chr(92) + m[1], word)}\b"


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur; a pattern counts once. A null text has none."""
    text = F.coalesce(text, F.lit(""))
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns], F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyword_score(text: Column, keywords: list[str], high_value: list[str]) -> Column:
    return hits(text, [words_pattern(k) for k in keywords]) + 2 * hits(text, ["(?i)" + p for p in high_value])


def good_quality(text: Column) -> Column:
    """A null text counts as empty. Enough lines that are not comments, no mark of a generated file in the first ten lines, no very long lines."""
    text = F.coalesce(text, F.lit(""))
    bare = lambda x: F.ltrim(x, F.lit(SPACES))
    head = F.lower(F.substring_index(text, "\n", 10))
    marked = reduce(lambda a, b: a | b, [head.contains(m) for m in GENERATED])
    # one pass over the lines: how many are filled, how many of these are no comments, and their characters
    sums = lambda n, code, total: F.struct(n.cast("bigint").alias("n"), code.cast("bigint").alias("code"), total.cast("bigint").alias("total"))
    added = lambda a, x: F.when(bare(x) == "", a).otherwise(sums(a["n"] + 1, a["code"] + (~bare(x).startswith("#")).cast("bigint"), a["total"] + F.length(x)))
    good = lambda s: (s["n"] > 0) & ~(s["code"] < 0.3 * s["n"]) & ~(F.try_divide(s["total"], s["n"]) > 200)
    return ~marked & F.aggregate(lines(text), sums(F.lit(0), F.lit(0), F.lit(0)), added, good)


def verdict(text: Column, keywords: list[str], high_value: list[str], least_lines: int = 10, most_lines: int = 2000, least_score: int = 2, score: Column | None = None) -> Column:
    """The first test that fails, cheap ones first, or ``pass``. ``score`` is the keyword score where it is known already.

    A null text counts as empty and is ``too_short`` (it has one empty line).
    """
    text = F.coalesce(text, F.lit(""))
    n = F.size(lines(text))
    score = keyword_score(text, keywords, high_value) if score is None else score
    return (
        F.when(n < least_lines, "too_short").when(n > most_lines, "too_long")
        .when(score < least_score, "no_keywords").when(~good_quality(text), "low_quality").otherwise("pass")
    )


def light_pass(text: Column, keywords: list[str] = LIGHT, least_lines: int = 10, most_lines: int = 1000, least: int = 2) -> Column:
    """The light filter: a range of line counts and enough keywords. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.size(lines(text))
    return (n >= least_lines) & (n <= most_lines) & (hits(text, [rf"(?i)\b{k}\b" for k in keywords]) >= least)


def priority(text: Column, keywords: list[str], high_value: list[str], found: tuple[Column, Column] | None = None) -> Column:
    """0 to 1: keywords (up to five), patterns of high value, and marks of structure. ``found`` has both hit counts if they are known.

    A null text counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    has = lambda *xs: reduce(lambda a, b: a | b, [text.contains(x) for x in xs]).cast("double")
    words, high = found or (hits(text, [words_pattern(k) for k in keywords]), hits(text, ["(?i)" + p for p in high_value]))
    score = F.least(words + 2 * high, F.lit(5)) + 0.5 * high
    score = score + 0.5 * has("class ") + 0.5 * has("def ") + 0.25 * has("import ") + 0.5 * has('"""', "'''") + 0.25 * has(" -> ", ": ")
    return F.least(score / 10, F.lit(1.0))


def imports(text: Column) -> Column:
    """Sorted names of the recognised libraries that are imported."""
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(rf"(?i)import\s+{n}|from\s+{n}"), n) for n in IMPORTS))))


def docstring(text: Column) -> Column:
    return text.contains('"""') | text.contains("'''")


# The training templates by source, for two model families; ``{}`` stands for the content.
PHI = {
    "code": "<|user|>\nWrite Python code for the following quant trading task.\n\n<|assistant|>\n{}<|end|>",
    "cot": "<|user|>\nSolve this trading problem with step-by-step reasoning.\n\n<|assistant|>\n{}<|end|>",
    "synthetic": "<|user|>\nImplement this trading strategy.\n\n<|assistant|>\n{}<|end|>",
    "other": "{}<|end|>",
}
DEEPSEEK = {
    "code": "User: Write Python code for this quant trading task.\n\nAssistant: {}",
    "cot": "User: Solve this trading problem with step-by-step reasoning.\n\nAssistant: {}",
    "other": "User: Implement this trading strategy.\n\nAssistant: {}",
}
IMPLEMENTATION = "### Implementation:"


def templated(content: Column, source: Column, templates: dict[str, str]) -> Column:
    def fill(template: str) -> Column:
        before, after = template.split("{}")
        return F.concat(F.lit(before), content, F.lit(after))

    out = F.when(F.lit(False), "")
    for name, template in templates.items():
        if name != "other":
            out = out.when(source == name, fill(template))
    return out.otherwise(fill(templates["other"]))


def phi_format(content: Column, source: Column) -> Column:
    """Synthetic content with an implementation mark is split at it into question and answer."""
    parts = F.split(content, IMPLEMENTATION, -1)
    marked = (source == "synthetic") & content.contains(IMPLEMENTATION)
    split = F.concat(F.lit("<|user|>\n"), F.get(parts, F.lit(0)), F.lit("\n\n<|assistant|>\n"), F.get(parts, F.lit(1)), F.lit("<|end|>"))
    return F.when(marked, split).otherwise(templated(content, source, PHI))


def sample_text(instruction: Column, output: Column, question: Column, answer: Column, text: Column, row: Column) -> Column:
    """One text from the alternative shapes of a finance sample; the last resort is the row as JSON."""
    return (
        F.when(instruction.isNotNull() & output.isNotNull(), F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Response:\n"), output))
        .when(question.isNotNull() & answer.isNotNull(), F.concat(F.lit("### Question:\n"), question, F.lit("\n\n### Answer:\n"), answer))
        .otherwise(F.coalesce(text, F.to_json(row)))
    )


def code_block(response: Column) -> Column:
    """What stands in the first Python fence (up to the next fence) of a response, with the two usual imports put in front if missing."""
    behind = F.when(response.contains("```python"), F.get(F.split(response, "```python", -1), F.lit(1))).otherwise(response)
    code = F.substring_index(behind, "```", 1)
    imports_ = F.filter(lines(code), lambda x: F.trim(x).startswith("import ") | F.trim(x).startswith("from "))
    for line in ("import pandas as pd", "import numpy as np"):
        code = F.when(F.exists(imports_, lambda x: x.contains(line)), code).otherwise(F.concat(F.lit(line + "\n"), code))
    return F.regexp_replace(code, r"^\s+|\s+$", "")


def strategy_shape(code: Column) -> Column:
    """A function, a return and one of the decisions, quoted either way."""
    quoted = reduce(lambda a, b: a | b, [code.contains(q + d + q) for d in ("long", "short", "flat") for q in ("'", '"')])
    return code.contains("def ") & code.contains("return") & quoted
