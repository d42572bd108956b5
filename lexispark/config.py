"""Settings with their defaults, checked when made."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

SYSTEM_PROMPT = """Ты — юридический помощник по российскому законодательству.

Правила ответа:
1. Отвечай ТОЛЬКО на основе предоставленного контекста (статей законов)
2. Если в контексте нет информации для ответа — честно скажи об этом
3. Указывай номера статей и названия кодексов при цитировании
4. Используй понятный язык, избегай излишней юридической терминологии
5. Структурируй ответ: сначала краткий вывод, затем детали
6. Отвечай по-русски
"""  # fixed value: the prompt must equal the known one


# The defaults below are fixed values: they equal those that users of such collections know.
@dataclass(frozen=True)
class Chunking:
    enabled: bool = True
    strategy: str = "parent_child"  # or "fixed", "none"
    chunk_size: int = 500
    chunk_overlap: int = 50
    child_min: int = 30
    child_max: int = 150
    children_per_parent: int = 3
    parent_max: int = 500
    parent_overlap: bool = False
    #: Paragraph separators, the second applied inside what the first leaves.
    separators: tuple[str, str] = ("\n\n", ";\n")

    def __post_init__(self) -> None:
        if self.strategy not in ("parent_child", "fixed", "none"):
            raise ValueError(f"unknown chunking strategy: {self.strategy}")
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and less than chunk_size")
        if self.children_per_parent < (2 if self.parent_overlap else 1):
            raise ValueError("children_per_parent is too small for this overlap")


@dataclass(frozen=True)
class Embedding:
    pooling: str = "mean"  # or "cls", "max"
    normalize: bool = True
    batch_size: int = 32
    max_length: int = 256

    def __post_init__(self) -> None:
        if self.pooling not in ("mean", "cls", "max"):
            raise ValueError(f"unknown pooling: {self.pooling}")


@dataclass(frozen=True)
class Sparse:
    language: str = "russian"
    min_token_length: int = 2
    stemming: bool = False

    def __post_init__(self) -> None:
        if self.stemming:
            raise ValueError("stemming is not supported")


@dataclass(frozen=True)
class Search:
    distance: str = "Cosine"  # or "Euclid", "Dot"
    hybrid: bool = True
    alpha: float = 0.9
    limit: int = 10
    score_threshold: float = 0.5
    #: Candidates of each leg for every result.
    over_fetch: int = 3
    #: Take a threshold or limit of 0 as not given, as `x or default` does.
    compat_zero: bool = False

    def given(self, value: float | None, default: float) -> float:
        return default if value is None or (self.compat_zero and not value) else value


@dataclass(frozen=True)
class Generator:
    """What a generator's model gets: see context.chat()."""

    model: str = "qwen3-vl-8b"
    max_tokens: int = 512
    temperature: float = 0.7
    system_prompt: str = SYSTEM_PROMPT


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    sparse: Sparse = field(default_factory=Sparse)
    search: Search = field(default_factory=Search)
    generator: Generator = field(default_factory=Generator)

    @classmethod
    def from_files(cls, folder: str, overrides: Sequence[str] = (), env: Mapping[str, str] = os.environ, main: str = "config") -> Config:
        """A configuration from a folder of YAML (or JSON) files.

        The main file's `defaults` list names an option of each group, as `- search: fast`, whose settings lie in
        search/fast.yaml; the main file's own sections go over them where `_self_` stands, at the end if it is not named. An override
        without a dot takes another option of a group (`search=exact`), others change settings as in with_overrides(). Values may read
        ${NAME}, ${NAME:other} and ${oc.env:NAME,other}. Sections and settings that this engine does not have are left out.
        """
        chosen = {o.split("=", 1)[0].strip(): o.split("=", 1)[1].strip() for o in overrides if "=" in o and "." not in o.split("=", 1)[0]}
        own = _file(folder, main)
        steps: list[Mapping] = []
        options = own.pop("defaults", None) or []
        for entry in [*options, *([] if "_self_" in options else ["_self_"])]:
            if entry == "_self_":
                steps.append(own)
            elif isinstance(entry, Mapping) and len(entry) == 1:
                (group, option) = next(iter(entry.items()))
                steps.append({group: _file(folder, f"{group}/{chosen.pop(group, option)}")})
            else:
                raise ValueError(f"an entry of defaults reads group: option, or _self_: {entry!r}")
        if chosen:
            raise ValueError(f"unknown groups: {', '.join(sorted(chosen))}")
        known = {f.name: {g.name for g in fields(getattr(cls(), f.name))} for f in fields(cls)}
        settings = [f"{part}.{name}={_text(value)}" for step in steps for part, section in step.items() if part in known and isinstance(section, Mapping) for name, value in section.items() if name in known[part] and value is not None]
        return cls().with_overrides([*settings, *(o for o in overrides if "." in o.split("=", 1)[0])], env)

    def with_overrides(self, overrides: Sequence[str] | Mapping[str, str], env: Mapping[str, str] = os.environ) -> Config:
        """This configuration with settings such as "search.limit=5" or {"search.limit": "5"}.

        A value becomes what its setting's default is (a number, true or false, text, a list by commas). ${NAME} in a
        value is taken from env, ${NAME:other} too, with a default; an unknown setting or name is an error.
        """
        pairs = overrides.items() if isinstance(overrides, Mapping) else (o.split("=", 1) for o in overrides)
        out = self
        for pair in pairs:
            if len(pair) != 2 or pair[0].count(".") != 1:
                raise ValueError(f"an override reads part.setting=value: {'='.join(pair)}")
            part, name = pair[0].strip().split(".")
            known = {f.name for f in fields(getattr(out, part))} if part in {f.name for f in fields(out)} else set()
            if name not in known:
                raise ValueError(f"unknown setting: {part}.{name}")
            old = getattr(out, part)
            out = replace(out, **{part: replace(old, **{name: _value(str(pair[1]), getattr(old, name), env)})})
        return out


def _file(folder: str, name: str) -> dict:
    """A file's settings; YAML needs its library, JSON none."""
    at = Path(folder) / name
    if at.with_suffix(".json").exists():
        return dict(json.loads(at.with_suffix(".json").read_text(encoding="utf-8")) or {})
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml library; JSON files do not") from e
    return dict(yaml.safe_load(at.with_suffix(".yaml").read_text(encoding="utf-8")) or {})


def _text(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def _value(text: str, like: object, env: Mapping[str, str]) -> object:
    def named(m: re.Match) -> str:
        name, other = (m[1], m[2]) if m[1] else (m[3], m[4])
        found = env.get(name, other)
        if found is None:
            raise ValueError(f"no value for ${{{name}}}")
        return found

    text = re.sub(r"\$\{oc\.env:(\w+)(?:,([^}]*))?\}|\$\{(\w+)(?::([^}]*))?\}", named, text)
    if isinstance(like, bool):
        if text.lower() not in ("true", "false"):
            raise ValueError(f"true or false expected: {text}")
        return text.lower() == "true"
    if isinstance(like, tuple):
        return tuple(text.split(","))
    return type(like)(text) if isinstance(like, (int, float)) else text
