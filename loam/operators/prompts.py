"""Prompts of the generation steps: contexts, examples and verdicts, filled in from a plan's axes.

The wording is this package's own and a parameter of each function; what is fixed is which axes a prompt carries, how
values become phrases, and that a value without a phrase fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.operators.taxonomy import AXES, fill, phrase, source_language

#: A phrase for each value of the axes that a context prompt spells out.
PHRASES: dict[str, dict[str, str]] = {
    "difficulty": {"easy": "short sentences and common terms", "medium": "ordinary technical terms", "hard": "dense specialist terms"},
    "noise_level": {"clean": "no flaws", "semi_noisy": "a few small flaws of punctuation and layout", "noisy": "many flaws, though still legible"},
    "challenge_type": {
        "straightforward": "plain wording", "terminology_ambiguity": "terms whose meaning depends on the context", "false_friends": "words that mislead between the two languages",
        "mixed_code_text": "prose mixed with commands or settings", "format_sensitive": "a layout that carries meaning",
    },
    "preservation_constraint": {
        "preserve_code_blocks": "one block of code or more", "preserve_markdown": "Markdown structure", "preserve_placeholders": "placeholders in braces", "preserve_cli_commands": "one terminal command or more",
    },
}

CONTEXT = """Write one {source_type} about {domain_subarea}, in {language} only.
Difficulty: {difficulty}.
Noise: {noise_level}.
Challenge: {challenge_type}.
It contains: {preservation_constraint}.
Return the document alone."""

EXAMPLE = """Make a training example from the document given.
Task: {task_type}. Challenge: {challenge_type}. Output: {output_format}. Constraint: {constraint_type}. Keep: {preservation_constraint}.
Return a JSON object with the keys context, instruction and response only."""

VERDICT = "Judge this example.\n" + "\n".join(f"{a}: {{{a}}}" for a in AXES) + "\n\nINSTRUCTION\n{instruction}\n\nCONTEXT\n{context}\n\nRESPONSE\n{response}\n"


def context_prompt(template: str = CONTEXT, phrases: dict[str, dict[str, str]] = PHRASES, of: str = "") -> Column:
    """Prompt for a source text: seven axes, four of them as phrases, the language from the task. ``of`` prefixes the axes' columns."""
    plain = {a: F.col(of + a) for a in ("source_type", "domain_subarea")}
    spelled = {a: phrase(F.col(of + a), phrases[a]) for a in phrases}
    return fill(template, language=source_language(F.col(of + "task_type")), **plain, **spelled)


def example_prompt(template: str = EXAMPLE, of: str = "") -> Column:
    """Prompt for an example: five axes as they are."""
    return fill(template, **{a: F.col(of + a) for a in ("task_type", "challenge_type", "output_format", "constraint_type", "preservation_constraint")})


def verdict_prompt(template: str = VERDICT, of: str = "") -> Column:
    """Prompt for a verdict: all nine axes and the three texts; null texts count as empty."""
    return fill(template, **{a: F.col(of + a) for a in AXES}, **{c: F.col(c) for c in ("instruction", "context", "response")})
