"""Schemas and keys of the archive's tables (1.4), and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATION = "NetworkCode string, StationCode string"

SCHEMAS = {
    "networks": "NetworkCode string, NetworkName string",
    "stations": f"{STATION}, StationName string, DateStart decimal(7,3), DateEnd decimal(7,3), auto_x double, auto_y double, auto_z double, lat double, lon double, height double, max_dist double, country_code string, marker int, alias string, dome string, Harpos_coeff_otl string",
    "rinex": f"{STATION}, ObservationYear int, ObservationMonth int, ObservationDay int, ObservationDOY int, ObservationFYear double, ObservationSTime timestamp_ntz, ObservationETime timestamp_ntz, ReceiverType string, ReceiverSerial string, ReceiverFw string, AntennaType string, AntennaSerial string, AntennaDome string, Filename string, Interval double, AntennaOffset double, Completion decimal(7,3)",
    "stationinfo": f"{STATION}, ReceiverCode string, ReceiverSerial string, ReceiverFirmware string, AntennaCode string, AntennaSerial string, AntennaHeight decimal(6,4), AntennaNorth decimal(12,4), AntennaEast decimal(12,4), HeightCode string, RadomeCode string, DateStart timestamp_ntz, DateEnd timestamp_ntz",
    "antennas": "AntennaCode string, AntennaDescription string",
    "receivers": "ReceiverCode string, ReceiverDescription string",
    "gamit_htc": "AntennaCode string, HeightCode string, v_offset double, h_offset double",
    "ppp_soln": f"{STATION}, X decimal(12,4), Y decimal(12,4), Z decimal(12,4), Year int, DOY int, ReferenceFrame string, sigmax double, sigmay double, sigmaz double, sigmaxy double, sigmaxz double, sigmayz double, hash long, orbit string",
    "ppp_soln_excl": f"{STATION}, Year int, DOY int",
    "gamit_soln": f"{STATION}, Project string, Year int, DOY int, FYear double, X double, Y double, Z double, sigmax double, sigmay double, sigmaz double, sigmaxy double, sigmaxz double, sigmayz double, VarianceFactor double",
    "gamit_soln_excl": f"{STATION}, Project string, Year int, DOY int, residual double",
    "stacks": f"{STATION}, Project string, Year int, DOY int, FYear double, X double, Y double, Z double, sigmax double, sigmay double, sigmaz double, VarianceFactor double, sigmaxy double, sigmaxz double, sigmayz double, name string",
    "etms": f"{STATION}, soln string, object string, t_ref double, jump_type int, relaxation array<double>, frequencies array<double>, params array<double>, sigmas array<double>, metadata string, hash long, jump_date timestamp_ntz, uid int, stack string",
    "etm_params": f"{STATION}, soln string, object string, terms int, frequencies array<double>, jump_type int, relaxation array<double>, Year int, DOY int, action string, uid int",
    "earthquakes": "date timestamp_ntz, lat double, lon double, depth double, mag double, strike1 double, dip1 double, rake1 double, strike2 double, dip2 double, rake2 double, id string, location string",
    "gamit_stats": "Project string, subnet int, Year int, DOY int, system string, cluster_size int, relaxed_constrains string, max_overconstrained string, updated_apr string, iterations int, nrms double, WL double, NL double, runtime int",
    "gamit_subnets": "Project string, subnet int, Year int, DOY int, centroid array<double>, stations array<string>, alias array<string>, ties array<string>",
    "gamit_ztd": f"{STATION}, Date timestamp_ntz, Project string, Year int, DOY int, model double, sigma double, ZTD double",
    "apr_coords": f"{STATION}, FYear double, x double, y double, z double, sn double, se double, su double, ReferenceFrame string, Year int, DOY int",
    "events": "event_id long, EventDate timestamp_ntz, EventType string, NetworkCode string, StationCode string, Year int, DOY int, Description string, stack string, module string, node string",
    "executions": "id int, script string, exec_date timestamp_ntz",
    "locks": "filename string, NetworkCode string, StationCode string",
    "keys": "KeyCode string, TotalChars int, rinex_col_out string, rinex_col_in string, isnumeric boolean",
    "rinex_tank_struct": "Level int, KeyCode string",
    "sources_servers": "server_id int, protocol string, fqdn string, username string, password string, path string, format string",
    "sources_stations": f"{STATION}, try_order int, server_id int, path string, format string",
}

S = ["NetworkCode", "StationCode"]
D = ["Year", "DOY"]

KEYS = {
    "networks": ["NetworkCode"], "stations": S, "rinex": [*S, "ObservationYear", "ObservationDOY", "Interval", "Completion"], "stationinfo": [*S, "DateStart"],
    "antennas": ["AntennaCode"], "receivers": ["ReceiverCode"], "gamit_htc": ["AntennaCode", "HeightCode"], "ppp_soln": [*S, *D, "ReferenceFrame"], "ppp_soln_excl": [*S, *D],
    "gamit_soln": [*S, "Project", *D], "gamit_soln_excl": [*S, "Project", *D], "stacks": [*S, *D, "name"], "etms": ["uid"], "etm_params": ["uid"], "earthquakes": ["date", "lat", "lon"],
    "gamit_stats": ["Project", "subnet", *D, "system"], "gamit_subnets": ["Project", "subnet", *D], "gamit_ztd": [*S, "Date", "Project", *D], "apr_coords": [*S, *D], "events": ["event_id", "EventDate"],
    "executions": ["id"], "locks": ["filename"], "keys": ["KeyCode"], "rinex_tank_struct": ["Level"], "sources_servers": ["server_id"], "sources_stations": [*S, "try_order"],
}

REFERENCES = {
    "stations": [(["NetworkCode"], "networks")], "rinex": [(S, "stations")], "stationinfo": [(S, "stations"), (["AntennaCode"], "antennas"), (["ReceiverCode"], "receivers")],
    "ppp_soln": [(S, "stations")], "gamit_soln": [(S, "stations")], "sources_stations": [(S, "stations"), (["server_id"], "sources_servers")],
}


def repeated_keys(rows: DataFrame, name: str) -> DataFrame:
    """Keys that several rows of a table have."""
    return rows.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, name: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For each reference of a table the rows whose target is missing."""
    return {to: rows.join(tables[to].select(*columns).distinct(), columns, "left_anti") for columns, to in REFERENCES.get(name, []) if to in tables}
