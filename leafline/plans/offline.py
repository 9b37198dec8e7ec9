"""Rule-bound stand-ins for text models, so that every step a model may take over runs, and has SQL, offline.

Each reads only its prompts and leaves some unanswered, as models do, which sends these down the offline path.
"""

from __future__ import annotations

import json
import re


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[ \t\r\n\f]+", text) if w]


def describe(prompts: list[str]) -> list[str]:
    """A theme from the first word of the sample and its number of words; samples that were cut get no JSON."""
    out = []
    for prompt in prompts:
        sample = prompt.split("Texts:\n", 1)[1].rsplit("\n\nNeighbours:\n", 1)[0]
        words = _words(sample)
        fits = words and not sample.endswith("\n[truncated]")
        out.append("```json\n" + json.dumps({"theme": words[0], "includes": [str(len(words))]}) + "\n```" if fits else "The sample was cut.")
    return out


def judge(prompts: list[str]) -> list[str]:
    """Passages are sufficient if they hold the last word of the question; a question without words gets no JSON."""
    out = []
    for prompt in prompts:
        question, passages = prompt.split("Question: ", 1)[1].split("\n\n", 1)
        words = _words(question.lower())
        out.append("Verdict: " + json.dumps({"sufficient": words[-1] in passages.lower(), "reasoning": words[-1]}) if words else "Nothing was asked.")
    return out


def ask(prompts: list[str]) -> list[str]:
    """A question about the first word of a text, answered by its last; texts that begin with no Latin letter get no JSON."""
    out = []
    for prompt in prompts:
        words = _words(prompt.split("as JSON with text, difficulty and answer.\n\n", 1)[1])
        plain = words and re.match("[A-Za-z]", words[0])
        out.append(json.dumps({"text": f"What about {words[0]}?", "difficulty": "easy", "answer": words[-1]}) if plain else "No question.")
    return out
