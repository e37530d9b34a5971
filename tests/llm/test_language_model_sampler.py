"""The language model's Gibbs sampler against exact enumeration of all seatings."""

import numpy as np
import pytest

from lodgelens.llm import language_model as lm


def seatings(n):
    """Table sizes of every way to seat n customers."""

    def rest(i, tables):
        if i == n:
            yield [len(t) for t in tables]
            return
        for t in tables:
            t.append(i)
            yield from rest(i + 1, tables)
            t.pop()
        tables.append([i])
        yield from rest(i + 1, tables)
        tables.pop()

    yield from rest(0, [])


def exact(customers, weight, discount):
    """Probability of each number of tables: weight per table, and (s - 1 - discount)… per further customer."""
    out = np.zeros(customers + 1)
    for sizes in seatings(customers):
        out[len(sizes)] += weight ** len(sizes) * np.prod([k - discount for s in sizes for k in range(1, s)])
    return out / out.sum()


@pytest.mark.parametrize("weight, discount", [(0.8, 0.4), (0.05, 0.9), (3.0, 0.1)])
def test_tables_are_drawn_from_their_conditional_distribution(weight, discount):
    n = 30_000
    for customers in (2, 5, 8):
        want = exact(customers, weight, discount)
        ways = lm.stirling(discount)[customers, : customers + 1] + np.arange(customers + 1) * np.log(weight)
        np.testing.assert_allclose(np.exp(ways - ways.max()) / np.exp(ways - ways.max()).sum(), want, atol=1e-12)
        drawn = lm.draw_tables(np.full(n, customers), np.full(n, weight), discount, np.random.default_rng(1))
        np.testing.assert_allclose(np.bincount(drawn.astype(int), minlength=customers + 1) / n, want, atol=0.015)


@pytest.mark.parametrize("weight, discount", [(0.8, 0.4), (0.3, 0.8)])
def test_moving_customers_keeps_that_distribution(weight, discount):
    n, customers = 20_000, 6
    seats = lm.Seats(np.full(n, customers), np.full(n, weight), discount, np.random.default_rng(2))
    for _ in range(lm.MOVES * (lm.BURN_IN + lm.SAMPLES)):
        seats.move(np.full(n, weight), discount)
        assert seats.sizes.min() >= 0 and seats.sizes.sum() == n * customers
    np.testing.assert_allclose(np.bincount(seats.tables, minlength=customers + 1) / n, exact(customers, weight, discount), atol=0.015)


def test_large_cells_keep_their_customers_and_count_their_tables():
    random = np.random.default_rng(3)
    customers = np.array([2, 3, 300, 5000, 70_000, lm.DRAWN_CUSTOMERS, lm.DRAWN_CUSTOMERS + 1])
    cells = lm.Cells(customers, random)
    for _ in range(lm.BURN_IN + lm.SAMPLES):
        tables = cells.sweep(np.full(len(customers), 2.0), 0.5)
        assert (tables >= 1).all() and (tables <= customers).all()
    seats = cells.moved
    ends = np.append(np.searchsorted(np.cumsum(seats.sizes), seats.before, side="right"), len(seats.sizes))
    for cell, c in enumerate(customers[cells.large]):
        sizes = seats.sizes[ends[cell] : ends[cell + 1]]
        assert sizes.sum() == c and (sizes > 0).sum() == seats.tables[cell]


def test_discount_and_weight_move_the_number_of_tables():
    random, customers = np.random.default_rng(4), np.full(2000, 200)
    few = lm.draw_tables(customers, np.full(2000, 0.01), 0.3, random).mean()
    many = lm.draw_tables(customers, np.full(2000, 5.0), 0.3, random).mean()
    assert 1 <= few < many < 200
