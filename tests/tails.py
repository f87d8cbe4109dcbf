"""Distribution tails in plain Python, for the tests to check the engine's
Column expressions against."""

import math


def chi2_sf_scalar(x, k):
    """P(X > x), X chi-square with k degrees of freedom: the same finite series as
    in textbooks, with Python's own log-gamma for every term."""
    if x <= 0:
        return 1.0
    h = x / 2.0
    if k % 2 == 0:
        logs = [i * math.log(h) - math.lgamma(i + 1) - h for i in range(k // 2)]
        rest = 0.0
    else:
        logs = [(i - 0.5) * math.log(h) - math.lgamma(i + 0.5) - h for i in range(1, (k - 1) // 2 + 1)]
        rest = math.erfc(math.sqrt(h))
    return min(1.0, rest + math.fsum(math.exp(v) for v in logs))


def normal_two_sided_scalar(z):
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided_scalar(t, nu, steps=200_000):
    """Simpson integration of the density from |t| on, by t = |t| + u / (1 - u)."""
    log_c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)

    def f(u):
        if u >= 1:
            return 0.0
        x = abs(t) + u / (1 - u)
        return math.exp(log_c - (nu + 1) / 2 * math.log1p(x * x / nu)) / (1 - u) ** 2

    h = (1 - 1e-9) / steps
    total = f(0) + f(1 - 1e-9) + math.fsum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps))
    return 2 * total * h / 3
