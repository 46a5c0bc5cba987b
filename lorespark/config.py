"""Settings of the engine. Values are fixed: results depend on them."""

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 420
    chunk_overlap: int = 80
    top_k: int = 4
    min_score: float = 0.1
    max_context_chars: int = 2200
    title_boost: float = 0.45
    heading_boost: float = 0.9
    ascii_bonus: float = 0.75
    ascii_penalty: float = 0.35
    k1: float = 1.5
    b: float = 0.75
    history_kept: int = 50
    history_listed: int = 20


SETTINGS = Settings()


def settings(over: Mapping | None = None) -> Settings:
    """The settings with some replaced; names that aren't settings are passed over."""
    if over is not None and not isinstance(over, Mapping):
        raise ValueError("settings have to be a mapping")
    known = {f.name for f in fields(Settings)}
    return replace(SETTINGS, **{k: v for k, v in (over or {}).items() if k in known})


def environment(path: str, base: Mapping[str, str] | None = None) -> dict[str, str]:
    """The environment with the lines NAME=value of a file over it. Blank lines, comments and a missing file say nothing."""
    out = dict(os.environ if base is None else base)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                name, equals, value = line.partition("=")
                if equals and not line.startswith("#") and name.strip():
                    out[name.strip()] = value.strip().strip("\"'")
    return out


#: Two-character words that carry no meaning in a question.
STOP_BIGRAMS = ("为什", "什么", "请结", "结合", "合课", "课程", "程资", "资料", "料简", "简要", "要说", "说明", "一下", "一般", "怎么", "如何", "请问", "问题", "这个")
#: Phrases of sentences that advertise and don't answer.
HINTS = ("我直接给你整理", "可以当说明书", "超全", "全覆盖")
