"""Kinematic expressions over logged trajectories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speed tolerance and zero-speed cut-off of the time estimate, sentinel for "no time".
SPEED_TOLERANCE = 0.1
ZERO_SPEED = 0.01
NO_TIME = -1.0


def body_frame(vec: list[Column], forward: list[Column], right: list[Column], up: list[Column]) -> list[Column]:
    """World vector projected on the vehicle axes."""

    def dot(axis):
        return sum((a * v for a, v in zip(axis[1:], vec[1:])), axis[0] * vec[0])

    return [dot(forward), dot(right), dot(up)]


def planar_norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def time_to_cover(speed: Column, accel: Column, distance: Column, vmax: float) -> Column:
    """Time over a distance: cruise at the cap, or accelerate to the cap and cruise, or accelerate only."""
    v = F.when(F.abs(speed) < ZERO_SPEED, F.lit(0.0)).otherwise(speed)
    capped = (F.abs(speed - vmax) < SPEED_TOLERANCE) | (speed > vmax)
    ramp = F.try_divide(F.lit(vmax * vmax) - v * v, 2.0 * accel)
    ramp_then_cruise = F.try_divide(F.lit(vmax) - v, accel) + (distance - ramp) / vmax
    ramp_only = F.try_divide(F.sqrt(v * v + 2.0 * accel * distance) - v, accel)
    return F.when(capped, distance / vmax).when(distance > ramp, ramp_then_cruise).otherwise(ramp_only)


def go_displacement(speed: Column, accel: Column, t: Column, vmax: float) -> Column:
    ramp_t = F.try_divide(F.lit(vmax) - speed, accel)
    free = speed * t + 0.5 * accel * t * t
    capped = speed * ramp_t + 0.5 * accel * ramp_t * ramp_t + vmax * (t - ramp_t)
    return F.when((speed < vmax) & (accel > 0), F.when(t >= ramp_t, capped).otherwise(free)).otherwise(speed * t)


def brake_displacement(speed: Column, t: Column, brake: float) -> Column:
    return F.greatest(F.lit(0.0), speed * t - 0.5 * brake * t * t)


def region_position(front: Column, rear: Column, near: Column, far: Column) -> Column:
    """before / after / inside a stretch [near, far] of the path."""
    touching = front.between(near, far) | rear.between(near, far)
    return F.when(front < near, F.lit("before")).when(rear > far, F.lit("after")).when(touching, F.lit("inside"))


def distance_to_region(position: Column, front: Column, near: Column) -> Column:
    return (
        F.when(position == "before", F.greatest(F.lit(0.0), near - front))
        .when(position.isin("inside", "after"), F.lit(0.0))
        .otherwise(F.lit(-1.0))
    )


def time_to_enter(position: Column, speed: Column, accel: Column, front: Column, near: Column, vmax: float) -> Column:
    return F.when(position == "before", time_to_cover(speed, accel, F.abs(near - front), vmax)).otherwise(F.lit(NO_TIME))


def time_to_leave(position: Column, speed: Column, accel: Column, rear: Column, far: Column, vmax: float) -> Column:
    return F.when(
        position.isin("before", "inside"), time_to_cover(speed, accel, F.abs(far - rear), vmax)
    ).otherwise(F.lit(NO_TIME))


def stop_profile_speed_kmh(distance: Column, speed: Column, vmax: float, decel: float, margin: float = 0.5) -> Column:
    """Speed that still stops at the region, never above the cap or the current speed, in km/h."""
    room = F.greatest(F.lit(0.0), distance - margin)
    return 3.6 * F.least(F.sqrt(2.0 * decel * room), F.lit(vmax), speed)
