"""Settings of modalities: frames, slots and their limits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .chain import Chain, modality
from .subsets import LAYOUT

SLOTS = {name: slots for name, slots, _ in LAYOUT}


def positive(value, name: str) -> int:
    """``value`` if it is a positive whole number; booleans aren't."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer, not {value!r}")
    return value


def frame_count(config: Mapping, modality: str) -> int:
    """The first that is set of the modality's own frames, its entry in frames, and the default."""
    frames = config.get("frames")
    table = frames if isinstance(frames, Mapping) else {"default": frames}
    candidates = ((f"{modality}.frames", (config.get(modality) or {}).get("frames")), (f"frames.{modality}", table.get(modality)), ("frames.default", table.get("default")))
    for name, value in candidates:
        if value is not None:
            return positive(value, name)
    raise ValueError(f"no frame count for {modality}")


def slot_count(config: Mapping, modality: str) -> int:
    if modality not in SLOTS:
        raise KeyError(modality)
    own = (config.get(modality) or {}).get("slot_count")
    return SLOTS[modality] if own is None else positive(own, f"{modality}.slot_count")


def check_time_steps(config: Mapping, max_time_steps: int, modalities: Iterable[str] = tuple(SLOTS)) -> None:
    """Every modality's slots need a time step each, whether it is enabled or not."""
    most = positive(max_time_steps, "fusion.max_time_steps")
    for name in modalities:
        if (needed := slot_count(config, name)) > most:
            raise ValueError(f"fusion.max_time_steps is {most}, {name} needs {needed}")


@dataclass(frozen=True)
class Section:
    """A part of a configuration that says what it expects, and where, if it finds something else."""

    data: Mapping
    name: str = ""

    def _get(self, key: str, kinds: type | tuple[type, ...], what: str, check: Callable = lambda v: True):
        value = self.data.get(key)
        if isinstance(value, bool) or not isinstance(value, kinds) or not check(value):
            raise ValueError(f"{self.name}{key} must be {what}, not {value!r}")
        return value

    def section(self, key: str) -> Section:
        return Section(self._get(key, Mapping, "a mapping"), f"{self.name}{key}.")

    def whole(self, key: str) -> int:
        return self._get(key, int, "a whole number")

    def number(self, key: str) -> float:
        return float(self._get(key, (int, float), "a number"))

    def text(self, key: str) -> str:
        return self._get(key, str, "a text that isn't blank", str.strip).strip()

    def path(self, key: str) -> str | None:
        """None if it isn't set; a blank path isn't one."""
        return None if self.data.get(key) is None else self.text(key)

    def names(self, key: str) -> tuple[str, ...]:
        found = self._get(key, list, "a list of names", lambda v: v and all(isinstance(x, str) for x in v))
        return tuple(x.strip() for x in found if x.strip())


def load_yaml(path: str, spark: SparkSession | None = None) -> Section:
    """A YAML file whose root is a mapping, read by Spark from wherever Spark reads, or from this machine without a session."""
    import yaml

    if spark is None:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    else:
        data = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(data, Mapping):
        raise ValueError(f"the root of {path} must be a mapping")
    return Section(data)


def chain_of(config: Section, widths: Mapping[str, int], modalities: Iterable[str] | None = None) -> Chain:
    """The chain that a configuration describes: its modalities (or those given) in the bank's order, over features of ``widths``.

    Every modality's slots must fit the time steps, enabled or not.
    """
    fusion = config.section("fusion")
    steps = fusion.whole("max_time_steps")
    check_time_steps(config.data, steps)
    wanted = list(modalities) if modalities is not None else list(config.names("modalities"))
    if unknown := [m for m in wanted if m not in SLOTS]:
        raise ValueError(f"the token bank has no place for {', '.join(unknown)}")
    if lacking := [m for m in wanted if m not in widths]:
        raise ValueError(f"no features for {', '.join(lacking)}")
    enabled = tuple(modality(m, widths[m], slot_count(config.data, m)) for m in SLOTS if m in wanted)
    return Chain(enabled, config.whole("dim"), fusion.whole("num_heads"), fusion.whole("num_layers"), fusion.number("mlp_ratio"), steps)
