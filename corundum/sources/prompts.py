"""Configuration that isn't data: prompt files, skills, aliases of fields, environment and model
settings. It is read on the driver and small; only its DataFrames meet documents."""

from __future__ import annotations

import ast
import csv
import os
import re
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from corundum.operators.rank import FIELD_ALIASES, Skill, ordered_unique

#: A field in a prompt: a quoted or back-quoted name before a colon, or a list item's.
FIELD = re.compile(r"""["'`]([A-Za-z][A-Za-z0-9_ ()%µ/.-]{1,60})["'`]\s*:""")
WORD = re.compile(r"[A-Za-z][A-Za-z0-9_+-]{2,}")
# Words that any prompt holds.
COMMON = frozenset("about above after also answer article based been before between both does each extract fields following format from given have into json list make more must name none null only other output paper provide return same should than that their them then there these they this those text using value values were when where which with without write your".split())


@dataclass(frozen=True)
class PromptSkill:
    """A prompt file: its instructions, and each prompt in it with the fields and words it names."""

    name: str
    instructions: str
    prompts: dict[str, str]
    fields: tuple[str, ...]
    keywords: tuple[str, ...]

    def skill(self, aliases: dict[str, tuple[str, ...]] | None = None) -> Skill:
        return Skill(self.name, self.fields, self.keywords, FIELD_ALIASES if aliases is None else aliases)


def string_constants(source: str) -> dict[str, str]:
    """The strings that a Python file assigns to names. The file is parsed, never run."""
    out: dict[str, str] = {}
    for node in ast.parse(source).body:
        if isinstance(node, ast.Assign):
            try:
                value = ast.literal_eval(node.value)
            except (ValueError, SyntaxError):
                continue  # not a constant
            if isinstance(value, str):
                out |= {t.id: value for t in node.targets if isinstance(t, ast.Name)}
    return out


def prompt_keywords(text: str, limit: int) -> tuple[str, ...]:
    """The first distinct words of a prompt that say something: four letters or more, not common."""
    words = (w.strip("_") for w in WORD.findall(text))
    return ordered_unique(tuple(w for w in words if len(w) >= 4 and w.lower() not in COMMON))[:limit]


def prompt_skills(folder: str | Path, own_words: dict[str, tuple[str, ...]] | None = None) -> dict[str, PromptSkill]:
    """The prompt files (*.py) of a folder that hold a prompt: PROMPT, or a name that ends in _PROMPT."""
    out = {}
    for path in sorted(Path(folder).glob("*.py")):
        constants = string_constants(path.read_text(encoding="utf-8"))
        prompts = {"default" if k == "PROMPT" else k.removesuffix("_PROMPT").lower(): v for k, v in constants.items() if k == "PROMPT" or k.endswith("_PROMPT")}
        if prompts:
            names = ordered_unique(tuple(f for p in prompts.values() for f in FIELD.findall(p)))
            parts = tuple(t for f in names for t in (f, *(x for x in re.split(r"[_\W]+", f) if len(x) > 2)))
            instructions = constants.get("INSTRUCTIONS", "")
            words = ordered_unique((*(own_words or {}).get(path.stem, ()), *parts, *prompt_keywords(instructions, 16)))
            out[path.stem] = PromptSkill(path.stem, instructions, prompts, names, words)
    return out


def select_skills(known: dict[str, PromptSkill], domain: str | None, names: dict[str, str] | None = None) -> tuple[list[PromptSkill], str | None]:
    """The skill of a domain (names: skills by domain), else all of them and a warning."""
    if not domain:
        return list(known.values()), None
    key = " ".join(domain.lower().replace("_", " ").split())
    name = (names or {}).get(key, key.replace(" ", "_"))
    return ([known[name]], None) if name in known else (list(known.values()), f"no skill for {domain!r}: all are tried")


def skill_rows(spark: SparkSession, known: dict[str, PromptSkill]) -> DataFrame:
    rows = [(s.name, v, p, list(s.fields), list(s.keywords)) for s in known.values() for v, p in s.prompts.items()]
    return spark.createDataFrame(rows, "skill string, variant string, prompt string, fields array<string>, keywords array<string>")


def read_skill(folder: str | Path, name: str) -> dict[str, str]:
    """name, description and prompt of a skill's SKILL.md, with or without front matter."""
    path = Path(folder) / name / "SKILL.md"
    if not path.exists():
        raise FileNotFoundError(f"no skill {name!r}; there are {', '.join(sorted(p.parent.name for p in Path(folder).glob('*/SKILL.md'))) or 'none'}")
    head, body = front_matter(path.read_text(encoding="utf-8"))
    return {"name": head.get("name", name), "description": head.get("description", ""), "prompt": body.strip()}


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Keys and values between two lines of dashes at the beginning, and the rest."""
    m = re.match(r"---[^\S\n]*\n(.*?)\n---[^\S\n]*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text
    pairs = (line.partition(":") for line in m[1].splitlines())
    return {k.strip(): v.strip() for k, sep, v in pairs if sep and k.strip()}, text[m.end() :]


def read_aliases(path: str | Path) -> dict[str, tuple[str, ...]]:
    """Other words for fields, from a CSV file of field and alias, beside those that are known."""
    out = {k: list(v) for k, v in FIELD_ALIASES.items()}
    with open(path, newline="", encoding="utf-8-sig") as f:
        for row in csv.DictReader(f):
            if row.get("field") and row.get("alias"):
                out.setdefault(row["field"], []).append(row["alias"])
    return {k: tuple(v) for k, v in out.items()}


def load_env(path: str | Path) -> dict[str, str]:
    """Variables of a file of NAME=value lines; those that are set already stay as they are. What was
    set is returned."""
    new: dict[str, str] = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, sep, value = line.strip().removeprefix("export ").partition("=")
            if sep and name.strip() and not name.startswith("#"):
                new.setdefault(name.strip(), value.strip().strip("\"'"))
    new = {k: v for k, v in new.items() if k not in os.environ}
    os.environ.update(new)
    return new


def env_number(name: str, default: float) -> float:
    """A variable as a number; default if it isn't set or isn't one."""
    try:
        return float(os.environ.get(name, "").strip() or default)
    except ValueError:
        return default


@dataclass(frozen=True)
class ModelConfig:
    """How a chat model is reached. Arguments go before variables of the provider, those before
    general ones, those before defaults."""

    provider: str
    api_key: str
    base_url: str
    model: str
    temperature: float = 0.01
    max_tokens: int = 1800
    timeout_seconds: float = 180.0

    @staticmethod
    def of(provider: str, *, base_url: str | None = None, model: str | None = None, default_url: str = "", default_model: str = "") -> ModelConfig:
        prefix = provider.upper().replace("-", "_")
        told = lambda what, given, default: next((v.strip() for v in (given, os.environ.get(f"{prefix}_{what}"), os.environ.get(f"LLM_{what}"), default) if v and v.strip()), "")
        key = told("API_KEY", None, "")
        if not key:
            raise ValueError(f"no API key: set {prefix}_API_KEY or LLM_API_KEY")
        return ModelConfig(provider, key, told("BASE_URL", base_url, default_url).rstrip("/"), told("MODEL", model, default_model), env_number("LLM_TEMPERATURE", 0.01), int(env_number("LLM_MAX_TOKENS", 1800)), env_number("LLM_TIMEOUT_SECONDS", 180.0))

    @property
    def url(self) -> str:
        return self.base_url if self.base_url.endswith("/chat/completions") else f"{self.base_url}/chat/completions"

    def public(self) -> dict[str, object]:
        """Everything but the key."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "api_key"} | {"api_key_configured": bool(self.api_key)}
