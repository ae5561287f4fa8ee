"""A run's settings as training scripts write them, in YAML or JSON: what a simulation needs of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from epochweave.functions.units import TrainingTime


@dataclass
class Settings:
    devices: int | None
    workers: int
    duration: TrainingTime
    global_batch: int
    data: dict = field(default_factory=dict)


def parsed(text: str) -> dict:
    """JSON, or YAML where its module is there."""
    try:
        out = json.loads(text)
    except ValueError:
        import yaml

        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError("settings are names with values")
    return out


def _first(settings: dict, *paths: str):
    """What stands under the first of the dotted paths that is there."""
    for path in paths:
        at = settings
        for name in path.split("."):
            at = at.get(name) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None


def settings_of(given: str | dict) -> Settings:
    """Names go by several layouts: parameters at the top or under "parameters", data under train_loader.dataset, dataset.train_dataset or train_dataset."""
    every = parsed(given) if isinstance(given, str) else given
    run = every.get("parameters", every)
    data = _first(run, "train_loader.dataset", "dataset.train_dataset", "train_dataset")
    if not isinstance(data, dict):
        raise ValueError("the training data must be named")
    inner = [k for k, v in data.items() if k.endswith("_kwargs") and k != "dataloader_kwargs" and isinstance(v, dict)]  # arguments of the data set in a group of their own
    data = {k: v for k, v in data.items() if k not in inner} | {k: v for group in inner for k, v in data[group].items()}
    duration = _first(run, "max_duration", "trainer.max_duration")
    if duration is None:
        raise ValueError("max_duration must be given")
    time = TrainingTime(duration, "ep") if isinstance(duration, int) else TrainingTime.of(duration)
    if time.unit not in ("ep", "ba"):
        raise ValueError(f"a run is so many epochs or batches, not {time}")
    batch = _first(run, "global_train_batch_size", "batch_size", "dataset.train_batch_size")
    workers = _first({"loader": run.get("train_loader"), "data": data}, "loader.num_workers", "data.dataloader_kwargs.num_workers")
    workers = 1 if workers is None else workers
    if not isinstance(batch, int) or not isinstance(workers, int):
        raise ValueError("the global batch size and the number of workers must be whole numbers")
    devices = _first(every, "compute.gpus")
    return Settings(None if devices is None else int(devices), workers, time, batch, data)
