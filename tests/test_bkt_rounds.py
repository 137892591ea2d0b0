"""Knowledge-tracing parameters against fifty scalar EM rounds, as many as the reference has."""

import random

from learntrail.operators import estimators as M


def scalar_em(seqs, rounds):
    known, learn, guess, slip = 0.3, 0.1, 0.2, 0.1
    for _ in range(rounds):
        first = moved = stayed = right = total = wrong_known = known_total = 0.0
        for y in seqs:
            a = ((1 - learn, learn), (0.0, 1.0))
            e = [(guess, 1 - slip) if v else (1 - guess, slip) for v in y]
            f = [[(1 - known) * e[0][0], known * e[0][1]]]
            for k in range(1, len(y)):
                f.append([sum(f[-1][i] * a[i][j] for i in (0, 1)) * e[k][j] for j in (0, 1)])
            b = [[1.0, 1.0]]
            for k in range(len(y) - 1, 0, -1):
                b.insert(0, [sum(a[i][j] * e[k][j] * b[0][j] for j in (0, 1)) for i in (0, 1)])
            z = sum(f[-1])
            g = [[f[k][i] * b[k][i] / z for i in (0, 1)] for k in range(len(y))]
            first += g[0][1]
            moved += sum(f[k][0] * a[0][1] * e[k + 1][1] * b[k + 1][1] / z for k in range(len(y) - 1))
            stayed += sum(f[k][0] * a[0][0] * e[k + 1][0] * b[k + 1][0] / z for k in range(len(y) - 1))
            right += sum(g[k][0] * y[k] for k in range(len(y)))
            total += sum(x[0] for x in g)
            wrong_known += sum(g[k][1] * (1 - y[k]) for k in range(len(y)))
            known_total += sum(x[1] for x in g)
        known, learn, guess, slip = (min(0.99, max(0.01, x)) for x in (first / len(seqs), moved / (moved + stayed), right / total, wrong_known / known_total))
    return known, learn, guess, slip


def test_bkt_has_fifty_rounds(spark):
    rng = random.Random(4)
    seqs = [[int(rng.random() < 0.25 + 0.1 * k) for k in range(2 + s % 5)] for s in range(40)]
    obs = spark.createDataFrame([(1, s, k, v) for s, y in enumerate(seqs) for k, v in enumerate(y)], "item_id long, student_id long, attempt_id long, y long")
    got = tuple(M.bkt_fit(obs).first())[1:]
    assert max(abs(a - b) for a, b in zip(got, scalar_em(seqs, 50), strict=True)) < 1e-6
    assert max(abs(a - b) for a, b in zip(scalar_em(seqs, 20), scalar_em(seqs, 50), strict=True)) > 1e-3
