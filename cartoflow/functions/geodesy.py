"""Geodetic conversions as chains of SQL expressions.

Each chain is a list of (name, expression); an expression may use the names before it.  The
same text runs on any SQL engine, so a chain can be compared across engines; tests hold the
chains against round trips and known points.  Formulas: Zhu 1994 (ECEF), Snyder 1987 §8
(transverse Mercator).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# WGS84.
A = 6378137.0
FLATTENING = 1 / 298.257223563
B = A * (1 - FLATTENING)
E2 = 1 - (B * B) / (A * A)
EP2 = (A * A) / (B * B) - 1
UTM_SCALE, FALSE_EAST, FALSE_NORTH_SOUTH = 0.9996, 500000.0, 10000000.0
# Origin latitude and longitude of the 19 plane rectangular zones (EPSG 6669 to 6687).
PLANE_ZONES = (
    (33.0, 129.5), (33.0, 131.0), (36.0, 132.1667), (33.0, 133.5), (36.0, 134.3333), (36.0, 136.0), (36.0, 137.1667),
    (36.0, 138.5), (36.0, 139.8333), (40.0, 140.8333), (44.0, 140.25), (44.0, 142.25), (44.0, 144.25), (26.0, 142.0),
    (26.0, 127.5), (26.0, 124.0), (26.0, 131.0), (20.0, 136.0), (26.0, 154.0),
)
ZONE_NAMES = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX")
PLANE_SCALE, DEFAULT_ZONE = 0.9999, 8

Chain = list[tuple[str, str]]


def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def apply(df: DataFrame, chain: Chain, keep: list[str]) -> DataFrame:
    """``df`` with the chain's names in ``keep``; the steps in between are dropped."""
    before = df.columns
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in chain]).select(*before, *[k for k in keep if k not in before])


def sql(chain: Chain) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in chain)


def wgs84_to_ecef(lat="lat", lon="lon", alt="alt") -> Chain:
    return [
        ("e_sin", f"sin(radians({lat}))"),
        ("e_n", f"{_d(A)} / sqrt(1 - {_d(E2)} * e_sin * e_sin)"),
        ("ecef_x", f"(e_n + {alt}) * cos(radians({lat})) * cos(radians({lon}))"),
        ("ecef_y", f"(e_n + {alt}) * cos(radians({lat})) * sin(radians({lon}))"),
        ("ecef_z", f"(e_n * {_d(1 - E2)} + {alt}) * e_sin"),
    ]


def ecef_to_wgs84(x="ecef_x", y="ecef_y", z="ecef_z") -> Chain:
    e2, a, b = _d(E2), _d(A), _d(B)
    return [
        ("z_r", f"sqrt({x} * {x} + {y} * {y})"),
        ("z_f", f"54 * {b} * {b} * {z} * {z}"),
        ("z_g", f"z_r * z_r + (1 - {e2}) * {z} * {z} - {e2} * {_d(A * A - B * B)}"),
        ("z_c", f"{e2} * {e2} * z_f * z_r * z_r / (z_g * z_g * z_g)"),
        ("z_s", "cbrt(1 + z_c + sqrt(z_c * z_c + 2 * z_c))"),
        ("z_k", "z_s + 1 / z_s + 1"),
        ("z_p", "z_f / (3 * z_k * z_k * z_g * z_g)"),
        ("z_q", f"sqrt(1 + 2 * {e2} * {e2} * z_p)"),
        ("z_r0", f"-(z_p * {e2} * z_r) / (1 + z_q) + sqrt({_d(0.5 * A * A)} * (1 + 1 / z_q) - z_p * (1 - {e2}) * {z} * {z} / (z_q * (1 + z_q)) - z_p * z_r * z_r / 2)"),
        ("z_a", f"z_r - {e2} * z_r0"),
        ("z_u", f"sqrt(z_a * z_a + {z} * {z})"),
        ("z_v", f"sqrt(z_a * z_a + (1 - {e2}) * {z} * {z})"),
        ("z_z0", f"{_d(B * B)} * {z} / ({a} * z_v)"),
        ("g_alt", f"z_u * (1 - {_d(B * B)} / ({a} * z_v))"),
        ("g_lat", f"degrees(atan(({z} + {_d(EP2)} * z_z0) / z_r))"),
        ("g_lon", f"degrees(atan2({y}, {x}))"),
    ]


def meridional_arc(phi: str) -> str:
    e2, e4, e6 = E2, E2**2, E2**3
    k = (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, 3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024, 15 * e4 / 256 + 45 * e6 / 1024, 35 * e6 / 3072)
    return f"{_d(A)} * ({_d(k[0])} * {phi} - {_d(k[1])} * sin(2 * {phi}) + {_d(k[2])} * sin(4 * {phi}) - {_d(k[3])} * sin(6 * {phi}))"


def transverse_mercator(lat: str, lon: str, lat_0: str, lon_0: str, scale: float, east: str, north: str, prefix: str = "m_") -> Chain:
    """``prefix``east and ``prefix``north of a point."""
    p = prefix
    steps = [
        ("phi", f"radians({lat})"),
        ("sin", f"sin({p}phi)"),
        ("cos", f"cos({p}phi)"),
        ("tan", f"tan({p}phi)"),
        ("n", f"{_d(A)} / sqrt(1 - {_d(E2)} * {p}sin * {p}sin)"),
        ("t", f"{p}tan * {p}tan"),
        ("c", f"{_d(EP2)} * {p}cos * {p}cos"),
        ("a", f"{p}cos * (radians({lon}) - radians({lon_0}))"),
        ("a2", f"{p}a * {p}a"),
        ("arc", f"{meridional_arc(p + 'phi')} - {meridional_arc(f'radians({lat_0})')}"),
        ("east", f"{_d(scale)} * {p}n * ({p}a + (1 - {p}t + {p}c) * {p}a2 * {p}a / 6 + (5 - 18 * {p}t + {p}t * {p}t + 72 * {p}c - {_d(58 * EP2)}) * {p}a2 * {p}a2 * {p}a / 120) + {east}"),
        ("north", f"{_d(scale)} * ({p}arc + {p}n * {p}tan * ({p}a2 / 2 + (5 - {p}t + 9 * {p}c + 4 * {p}c * {p}c) * {p}a2 * {p}a2 / 24 + (61 - 58 * {p}t + {p}t * {p}t + 600 * {p}c - {_d(330 * EP2)}) * {p}a2 * {p}a2 * {p}a2 / 720)) + {north}"),
    ]
    return [(p + n, e) for n, e in steps]


def utm_zone(lon: str = "lon") -> str:
    return f"CAST(floor(({lon} + 180) / 6) AS INT) % 60 + 1"


def utm(lat="lat", lon="lon", zone: str | None = None) -> Chain:
    """utm_zone, m_east, m_north; the false northing follows the sign of the latitude."""
    north = f"CASE WHEN {lat} < 0 THEN {_d(FALSE_NORTH_SOUTH)} ELSE {_d(0.0)} END"
    first = [("utm_zone", zone or utm_zone(lon)), ("utm_lon0", "CAST((utm_zone - 1) * 6 - 177 AS DOUBLE)")]
    return first + transverse_mercator(lat, lon, _d(0.0), "utm_lon0", UTM_SCALE, _d(FALSE_EAST), north)


def utm_inverse(east="m_east", north="m_north", zone="utm_zone", south="false") -> Chain:
    """u_lat, u_lon; the hemisphere is a flag, not a sign."""
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    k = (3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512)
    mu = A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256)
    return [
        ("u_mu", f"(({north}) - CASE WHEN {south} THEN {_d(FALSE_NORTH_SOUTH)} ELSE {_d(0.0)} END) / {_d(UTM_SCALE)} / {_d(mu)}"),
        ("u_phi", f"u_mu + {_d(k[0])} * sin(2 * u_mu) + {_d(k[1])} * sin(4 * u_mu) + {_d(k[2])} * sin(6 * u_mu) + {_d(k[3])} * sin(8 * u_mu)"),
        ("u_w", f"1 - {_d(E2)} * sin(u_phi) * sin(u_phi)"),
        ("u_n", f"{_d(A)} / sqrt(u_w)"),
        ("u_r", f"{_d(A * (1 - E2))} / (u_w * sqrt(u_w))"),
        ("u_t", "tan(u_phi) * tan(u_phi)"),
        ("u_c", f"{_d(EP2)} * cos(u_phi) * cos(u_phi)"),
        ("u_d", f"({east} - {_d(FALSE_EAST)}) / (u_n * {_d(UTM_SCALE)})"),
        ("u_d2", "u_d * u_d"),
        ("u_lat", f"degrees(u_phi - u_n * tan(u_phi) / u_r * (u_d2 / 2 - (5 + 3 * u_t + 10 * u_c - 4 * u_c * u_c - {_d(9 * EP2)}) * u_d2 * u_d2 / 24 + (61 + 90 * u_t + 298 * u_c + 45 * u_t * u_t - {_d(252 * EP2)} - 3 * u_c * u_c) * u_d2 * u_d2 * u_d2 / 720))"),
        ("u_lon", f"({zone} - 1) * 6 - 177 + degrees((u_d - (1 + 2 * u_t + u_c) * u_d2 * u_d / 6 + (5 - 2 * u_c + 28 * u_t - 3 * u_c * u_c + {_d(8 * EP2)} + 24 * u_t * u_t) * u_d2 * u_d2 * u_d / 120) / cos(u_phi))"),
    ]


def plane_rectangular(lat="lat", lon="lon", zone: int = DEFAULT_ZONE) -> Chain:
    lat_0, lon_0 = PLANE_ZONES[zone - 1 if 1 <= zone <= len(PLANE_ZONES) else DEFAULT_ZONE - 1]
    return transverse_mercator(lat, lon, _d(lat_0), _d(lon_0), PLANE_SCALE, _d(0.0), _d(0.0), "j_")


def great_circle(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Distance on the sphere of the semimajor axis; all arguments are radians."""
    h = f"(power(sin(({lat2} - {lat1}) / 2), 2) + cos({lat1}) * cos({lat2}) * power(sin(({lon2} - {lon1}) / 2), 2))"
    return f"{_d(A)} * 2 * atan2(sqrt({h}), sqrt(1 - {h}))"


def north_west_up(x="ecef_x", y="ecef_y", z="ecef_z", radius: float = A) -> Chain:
    """Axes of the local frame at an ECEF point: nx.. towards the pole, wx.. to the west, ux.. away from the centre."""
    return [
        ("l_r", f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"),
        ("ux", f"{x} / l_r"), ("uy", f"{y} / l_r"), ("uz", f"{z} / l_r"),
        ("l_nn", f"sqrt({x} * {x} + {y} * {y} + ({_d(radius)} - {z}) * ({_d(radius)} - {z}))"),
        ("l_px", f"-{x} / l_nn"), ("l_py", f"-{y} / l_nn"), ("l_pz", f"({_d(radius)} - {z}) / l_nn"),
        ("l_dot", "l_px * ux + l_py * uy + l_pz * uz"),
        ("l_ax", "l_px - l_dot * ux"), ("l_ay", "l_py - l_dot * uy"), ("l_az", "l_pz - l_dot * uz"),
        ("l_an", "sqrt(l_ax * l_ax + l_ay * l_ay + l_az * l_az)"),
        ("nx", "l_ax / l_an"), ("ny", "l_ay / l_an"), ("nz", "l_az / l_an"),
        ("wx", "uy * nz - uz * ny"), ("wy", "uz * nx - ux * nz"), ("wz", "ux * ny - uy * nx"),
    ]


def tile_pnoa(east: str, north: str) -> str:
    return f"concat('PNOA_MMS_', CAST(CAST(floor({east} / 1000) AS BIGINT) AS STRING), '_', CAST(CAST(floor({north} / 1000) AS BIGINT) AS STRING))"


def tile_icgc(east: str, north: str) -> str:
    return f"concat(CAST(CAST(floor({east} / 1000) AS BIGINT) AS STRING), lpad(CAST(CAST(floor({north} / 1000) AS BIGINT) - 4000 AS STRING), 3, '0'))"


def tile_japan(east: str, north: str, zone: int = DEFAULT_ZONE) -> Chain:
    """The eight-character mesh code of map information level 500: blocks of 30 x 40 km, 3 x 4 km, 300 x 400 m, counted from the north-west corner."""
    return [
        ("t_row", f"CAST(floor((300000 - ({north})) / 30000) AS INT)"),
        ("t_col", f"CAST(floor((({east}) + 160000) / 40000) AS INT)"),
        ("t_dn", f"(300000 - ({north})) - t_row * 30000"),
        ("t_de", f"(({east}) + 160000) - t_col * 40000"),
        ("t_r5", "CAST(floor(t_dn / 3000) AS INT)"),
        ("t_c5", "CAST(floor(t_de / 4000) AS INT)"),
        ("t_r", "CAST(floor((t_dn - t_r5 * 3000) / 300) AS INT)"),
        ("t_c", "CAST(floor((t_de - t_c5 * 4000) / 400) AS INT)"),
        ("tile", f"concat('{zone:02d}', substring('ABCDEFGHIJKLMNOPQRST', t_row + 1, 1), substring('ABCDEFGH', t_col + 1, 1), CAST(t_r5 AS STRING), CAST(t_c5 AS STRING), CAST(t_r AS STRING), CAST(t_c AS STRING))"),
    ]
