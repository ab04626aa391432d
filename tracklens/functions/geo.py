"""Distance, bearing and projection expressions. The three distance models stay separate on purpose."""

from pyspark.sql import Column, functions as F

from tracklens import constants as K


def haversine_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared half-chord of the great circle; arguments in degrees."""
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    return (
        F.sin(half_lat) * F.sin(half_lat)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    )


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Label and volume distance (asin form)."""
    root = F.sqrt(haversine_term(lat1, lon1, lat2, lon2))
    return F.lit(2.0 * K.EARTH_RADIUS_M) * F.asin(F.when(root > 1.0, F.lit(1.0)).otherwise(root))


def range_bearing(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Quality-control range (atan2 form) and initial bearing in [0, 360) degrees."""
    term = haversine_term(lat0, lon0, lat, lon)
    angle = F.lit(2.0) * F.atan2(F.sqrt(term), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - term)))
    d_lon = F.radians(lon - lon0)
    east = F.sin(d_lon) * F.cos(F.radians(lat))
    north = (
        F.cos(F.radians(lat0)) * F.sin(F.radians(lat))
        - F.sin(F.radians(lat0)) * F.cos(F.radians(lat)) * F.cos(d_lon)
    )
    return F.lit(K.EARTH_RADIUS_M) * angle, F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def plane_x(lon: Column, lat0, lon0) -> Column:
    """East metres from the airport on the local plane used by features."""
    return (lon - lon0) * F.lit(K.METRES_PER_DEGREE) * F.cos(F.radians(F.lit(lat0) if isinstance(lat0, float) else lat0))


def plane_y(lat: Column, lat0) -> Column:
    """North metres from the airport on the local plane used by features."""
    return (lat - lat0) * F.lit(K.METRES_PER_DEGREE)


def angle_difference(left: Column, right: Column) -> Column:
    """Absolute angle between two headings, in [0, pi]."""
    return F.abs(F.pmod(left - right + F.pi(), F.lit(2.0) * F.pi()) - F.pi())


def circular_error_deg(left: Column, right: Column) -> Column:
    return F.abs(F.pmod(left - right + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))


def cpa_seconds(rx: Column, ry: Column, vx: Column, vy: Column, horizon_s: float) -> Column:
    """Time of closest approach clipped to [0, horizon]; 0 where the relative speed vanishes."""
    speed2 = vx * vx + vy * vy
    free = F.when(speed2 <= 1e-9, F.lit(0.0)).otherwise(-(rx * vx + ry * vy) / speed2)
    return F.greatest(F.lit(0.0), F.least(F.lit(float(horizon_s)), free))


def constant_velocity_delta(lat: Column, speed: Column, heading: Column, seconds: float) -> tuple[Column, Column]:
    """Degrees moved north and east in the given time at constant speed and heading."""
    d_lat = speed * F.cos(heading) * F.lit(float(seconds)) / F.lit(K.METRES_PER_DEGREE)
    d_lon = speed * F.sin(heading) * F.lit(float(seconds)) / (
        F.lit(K.METRES_PER_DEGREE) * F.greatest(F.lit(0.1), F.cos(F.radians(lat)))
    )
    return d_lat, d_lon
