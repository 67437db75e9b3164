"""Deterministic long-form cases from the 31-bit stream: golden data for tests."""

from __future__ import annotations

from tallyframe.functions.rng import lcg31_list


def number_list(seed: int, skip: int, least: int, most: int, n: int) -> list[int]:
    """n numbers from least to most, from the stream's draws after ``skip``."""
    states = lcg31_list(seed, skip + n)[skip:]
    return [least + int(s / 0x7FFFFFFF * (most - least + 1)) for s in states]


def case_row(kind: str, numbers: list[int]) -> dict:
    """A case that asks for a figure of a list, with a number grader."""
    figures = {"sum": sum(numbers), "count_even": sum(x % 2 == 0 for x in numbers), "maximum": max(numbers), "sum_above_500": sum(x for x in numbers if x > 500)}
    return {"id": f"{kind}-{len(numbers)}", "task": f"Give the {kind.replace('_', ' ')} of: {', '.join(map(str, numbers))}", "category": "longform", "difficulty": "hard", "grader": {"number": {"expected": figures[kind]}}}
