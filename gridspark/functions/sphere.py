"""Coordinates on the sphere as column expressions: rotated poles and longitudes in one turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_turn(lon: Column) -> Column:
    """The longitude between -180 and 180 degrees."""
    return lon - 360.0 * F.round(lon / 360.0)


def _arc(sine: Column) -> Column:
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))))


def to_geographic(rlat: Column, rlon: Column, pole_lat: Column, pole_lon: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a point given in a system whose north pole lies at ``pole_lat, pole_lon``.

    The zero meridian of the rotated system runs from its pole through the geographic south, as weather models have it.
    """
    lat, lon, top = F.radians(rlat), F.radians(rlon), F.radians(pole_lat)
    north = F.cos(top) * F.sin(lat) - F.sin(top) * F.cos(lat) * F.cos(lon)
    east = -F.cos(lat) * F.sin(lon)
    return (_arc(F.sin(top) * F.sin(lat) + F.cos(top) * F.cos(lat) * F.cos(lon)),
            one_turn(pole_lon + F.degrees(F.atan2(east, north))))


def to_rotated(lat: Column, lon: Column, pole_lat: Column, pole_lon: Column) -> tuple[Column, Column]:
    """The inverse of ``to_geographic``: rotated latitude and longitude."""
    phi, turn, top = F.radians(lat), F.radians(lon - pole_lon), F.radians(pole_lat)
    north = F.cos(top) * F.sin(phi) - F.sin(top) * F.cos(phi) * F.cos(turn)
    return (_arc(F.sin(top) * F.sin(phi) + F.cos(top) * F.cos(phi) * F.cos(turn)),
            F.degrees(F.atan2(-F.cos(phi) * F.sin(turn), north)))
