"""The configuration document: directory, teams, users."""

from __future__ import annotations

from .sources.documents import load_json
from .sources.sinks import write_json


class Config:
    """Reads and changes one JSON file. Every change returns what there is to say about it."""

    def __init__(self, path: str):
        self.path, self.data = path, load_json(path)

    def save(self) -> None:
        self.data["users"] = sorted(self.data.get("users", []), key=lambda u: u["name"])
        write_json(self.data, self.path)

    def init(self, directory: str, output_file: str = "disk_usage_report.json") -> str:
        self.data = {"directory": directory, "output_file": output_file, "teams": [], "users": []}
        self.save()
        return f"Configuration for {directory} written."

    def set_directory(self, directory: str) -> str:
        if not self.data:
            return "No configuration. Run --init first."
        self.data["directory"] = directory
        self.save()
        return f"Directory is now {directory}."

    def team_id(self, team: str) -> object | None:
        return next((t["team_id"] for t in self.data.get("teams", []) if t["name"] == team), None)

    def add_team(self, team: str) -> str:
        if self.team_id(team) is not None:
            return f"Team {team} is there already."
        teams = self.data.setdefault("teams", [])
        teams.append({"name": team, "team_id": max([int(t["team_id"]) for t in teams], default=0) + 1})
        self.save()
        return f"Team {team} added."

    def add_user(self, name: str, team: str) -> str:
        number = self.team_id(team)
        if number is None:
            return f"There is no team {team}."
        users = self.data.setdefault("users", [])
        if any(u["name"] == name for u in users):
            return f"User {name} is there already."
        users.append({"name": name, "team_id": number})
        self.save()
        return f"User {name} added."

    def remove_user(self, name: str) -> str:
        left = [u for u in self.data.get("users", []) if u["name"] != name]
        if len(left) == len(self.data.get("users", [])):
            return f"There is no user {name}."
        self.data["users"] = left
        self.save()
        return f"User {name} removed."
