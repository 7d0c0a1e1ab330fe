"""Short and pet forms of given names."""

from __future__ import annotations

# Short and pet forms of Italian given names; a parameter of the readers.
NICKNAMES = {
    "alberto": ("berto",),
    "alessandro": ("ale", "sandro", "alex"),
    "andrea": ("drea",),
    "angela": ("angelina",),
    "antonio": ("toni", "tonino", "nino"),
    "bartolomeo": ("bortolo", "meo"),
    "carlo": ("carletto",),
    "caterina": ("rina", "cati", "catia"),
    "cristina": ("cri",),
    "daniela": ("dani",),
    "domenico": ("menico", "mimmo"),
    "elisabetta": ("lisa", "betta", "elisa"),
    "federico": ("fede", "rico"),
    "filippo": ("pippo",),
    "francesco": ("franz", "checco", "franco", "cecco"),
    "gabriele": ("lele",),
    "giacomo": ("giacomino", "mino"),
    "giovanni": ("gianni", "nanni", "vanni"),
    "giuseppe": ("bepi", "beppe", "pino", "peppe"),
    "guglielmo": ("memo",),
    "leonardo": ("nardo", "leo"),
    "lorenzo": ("renzo", "enzo"),
    "luigi": ("gigi", "gino"),
    "maddalena": ("lena", "madda"),
    "margherita": ("rita", "ghita"),
    "maria": ("mariuccia",),
    "matteo": ("teo",),
    "michele": ("michi",),
    "nicola": ("nico", "cola"),
    "patrizia": ("patti",),
    "pietro": ("piero", "pierino"),
    "raffaella": ("lella", "raffa"),
    "roberto": ("robi",),
    "rosa": ("rosina", "rosetta"),
    "salvatore": ("salvo", "turi"),
    "stefano": ("ste",),
    "teresa": ("resi", "teresina"),
    "umberto": ("berto",),
    "valentina": ("vale",),
    "vincenzo": ("cencio", "enzo", "renzo"),
}
