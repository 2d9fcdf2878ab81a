"""Normal-distribution Column functions (JVM side, no UDF).

* ``norm_ppf``: inverse standard-normal CDF, Wichura's algorithm AS241
  (Applied Statistics 37(3), 1988) evaluated as a Column expression; relative
  accuracy about 1e-16.
* ``norm_pdf``: standard-normal density.
* ``hashed_normal``: a standard normal draw that depends only on
  ``(seed, path, step)``; the same numbers come out whatever the partitioning,
  so Monte Carlo results are reproducible on any cluster size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# AS241 (PPND16) coefficients, ascending powers, as published.
# Central region |p - 0.5| <= 0.425, polynomial in r = 0.180625 - q^2.
AS241_A = (3.3871328727963666080e+0, 1.3314166789178437745e+2, 1.9715909503065514427e+3,
           1.3731693765509461125e+4, 4.5921953931549871457e+4, 6.7265770927008700853e+4,
           3.3430575583588128105e+4, 2.5090809287301226727e+3)
AS241_B = (1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
           2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4,
           5.2264952788528545610e+3)
# Intermediate tail, r = sqrt(-ln(min(p, 1-p))) <= 5, polynomial in r - 1.6.
AS241_C = (1.42343711074968357734e+0, 4.63033784615654529590e+0, 5.76949722146069140550e+0,
           3.64784832476320460504e+0, 1.27045825245236838258e+0, 2.41780725177450611770e-1,
           2.27238449892691845833e-2, 7.74545014278341407640e-4)
AS241_D = (1.0, 2.05319162663775882187e+0, 1.67638483018380384940e+0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
           1.05075007164441684324e-9)
# Far tail, r > 5, polynomial in r - 5.
AS241_E = (6.65790464350110377720e+0, 5.46378491116411436990e+0, 1.78482653991729133580e+0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7)
AS241_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
           2.04426310338993978564e-15)


def _horner(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p) -> Column:
    """Inverse standard-normal CDF of a probability column (NULL outside (0,1))."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - F.lit(0.5)
    r_c = F.lit(0.180625) - q * q
    central = q * _horner(AS241_A, r_c) / _horner(AS241_B, r_c)
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    mid = _horner(AS241_C, r - F.lit(1.6)) / _horner(AS241_D, r - F.lit(1.6))
    far = _horner(AS241_E, r - F.lit(5.0)) / _horner(AS241_F, r - F.lit(5.0))
    tail = F.when(r <= F.lit(5.0), mid).otherwise(far)
    signed_tail = F.when(q < 0, -tail).otherwise(tail)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= F.lit(0.425), central)
            .otherwise(signed_tail))


def norm_pdf(z) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return F.exp(-(z * z) / F.lit(2.0)) / F.lit(math.sqrt(2.0 * math.pi))


_TWO_52 = float(2 ** 52)


def hashed_normal(seed, path, step) -> Column:
    """Box-Muller normal from md5(seed|path|step).

    The first 13 hex digits give u1 = (h1 + 1) / (2^52 + 1) in (0, 1], the
    next 13 give u2 = h2 / 2^52 in [0, 1). The same expression is written in
    SQL for the oracle, so Monte Carlo results have an exact reference.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in (seed, path, step)]
    h = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    h1 = F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
    h2 = F.conv(F.substring(h, 14, 13), 16, 10).cast("double")
    u1 = (h1 + F.lit(1.0)) / F.lit(_TWO_52 + 1.0)
    u2 = h2 / F.lit(_TWO_52)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
