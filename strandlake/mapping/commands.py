"""Command lines of external read mappers, and read sets. Mappers are run by ``run``, where they are on the executors' PATH."""

from __future__ import annotations

import re
import shlex
import shutil
import subprocess
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

#: Presets of minimap2 by the end of the mapper's name (fixed values of that tool); rammap has the same ones.
PRESETS = {"sr": "sr", "ont": "map-ont", "pb": "map-pb", "hifi": "map-hifi", "lr-hq": "lr:hq", "no-preset": None}
MAPPERS = ["strobealign", "bwa-mem", "bwa-mem2", "minibwa", *(f"{tool}-{end}" for tool in ("minimap2", "rammap") for end in PRESETS)]
#: Least versions that are known to work.
LEAST = {"samtools": "1.9", "minimap2": "2.24", "bwa-mem2": "2.0", "strobealign": "0.11.0", "minibwa": "0.2", "rammap": "1.1.1"}
#: How a tool is asked for its version where that is not ``--version``.
_ASKED = {"bwa-mem2": "version", "minibwa": "version"}


@dataclass(frozen=True)
class ReadSet:
    """Reads of a sample: two files of mates, one file of both in turns, or single reads."""

    files: tuple[str, ...]
    interleaved: bool = False


def read_sets(coupled: Sequence[str] = (), read1: Sequence[str] = (), read2: Sequence[str] = (), interleaved: Sequence[str] = (), single: Sequence[str] = ()) -> list[ReadSet]:
    """All read sets: pairs, then interleaved files, then single ones."""
    if len(read1) != len(read2):
        raise ValueError("the lists of first and second mates differ in length")
    if len(coupled) % 2:
        raise ValueError("coupled reads need an even number of files")
    pairs = [*zip(read1, read2), *zip(coupled[::2], coupled[1::2])]
    return [*(ReadSet(p) for p in pairs), *(ReadSet((f,), True) for f in interleaved), *(ReadSet((f,)) for f in single)]


def sample_name(reference: str | None, reads: ReadSet) -> str:
    first = reads.files[0].rsplit("/", 1)[-1]
    return f"{reference.rsplit('/', 1)[-1]}/{first}" if reference else first


def mapping_command(mapper: str, reference: str, reads: ReadSet, threads: int = 1, extra: str = "", scratch: str = "minimap2-parts") -> list[str]:
    """The command, as an argument list, that writes SAM to standard output. ``scratch`` is a prefix for files of minimap2's own."""
    if mapper not in MAPPERS:
        raise ValueError(f"unknown mapper {mapper}")
    more, files, n = shlex.split(extra), list(reads.files), str(threads)
    paired = reads.interleaved or len(files) == 2
    tool, _, end = mapper.partition("-")
    if tool in ("minimap2", "rammap"):
        if paired and end in ("ont", "pb", "hifi", "lr-hq"):
            raise ValueError(f"{mapper} takes single reads only")
        preset = ["-x", PRESETS[end]] if PRESETS[end] else []
        parts = ["--split-prefix", scratch] if tool == "minimap2" else []
        return [tool, "-a", *parts, *preset, "-t", n, *(["--frag", "no"] if end == "sr" and not paired else []), *more, reference, *files]
    if mapper == "minibwa":
        if reads.interleaved:
            raise ValueError("minibwa takes no interleaved reads")
        return ["minibwa", "map", "-t", n, *more, reference, *files]
    if mapper == "strobealign":
        return ["strobealign", "-t", n, *(["--interleaved"] if reads.interleaved else []), *more, reference, *files]
    return [*(["bwa"] if mapper == "bwa-mem" else ["bwa-mem2"]), "mem", "-t", n, *(["-p"] if reads.interleaved else []), *more, reference, *files]


def abundance_command(reference: str, reads: ReadSet, threads: int = 1, extra: str = "") -> list[str]:
    return ["strobealign", "--aemb", "-t", str(threads), *(["--interleaved"] if reads.interleaved else []), *shlex.split(extra), reference, *reads.files]


def needs(tool: str) -> None:
    """Raise RuntimeError where a tool is missing or too old."""
    if shutil.which(tool) is None:
        raise RuntimeError(f"{tool} is not on the PATH (version {LEAST.get(tool, 'any')} or later is needed)")
    if tool in LEAST:
        said = subprocess.run([tool, _ASKED.get(tool, "--version")], capture_output=True, text=True, check=False)
        found = re.search(r"\d+(\.\d+)+", said.stdout + said.stderr)
        if found and [*map(int, found[0].split("."))] < [*map(int, LEAST[tool].split("."))]:
            raise RuntimeError(f"{tool} {found[0]} is older than {LEAST[tool]}")


def output_lines(command: list[str]) -> Iterator[str]:
    """Run a mapper and stream what it writes, line by line."""
    needs(command[0])
    with subprocess.Popen(command, stdout=subprocess.PIPE, text=True) as run:
        for line in run.stdout:
            yield line.rstrip("\n")
    if run.returncode:
        raise RuntimeError(f"{command[0]} ended with {run.returncode}")
