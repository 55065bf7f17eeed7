"""A traversal's graph as an HTML page."""

from __future__ import annotations

import html
import json
import re
import tempfile
import webbrowser

from trigraph.functions.files import Files

MOST_LINKS = 5000

PAGE = """<!doctype html>
<meta charset="utf-8"><title>{title}</title>
<style>body{{margin:0;font:13px sans-serif;background:{back}}}svg{{width:100vw;height:100vh}}line{{stroke:#888}}circle{{fill:{dot}}}text{{fill:{ink}}}</style>
<svg id="g"></svg>
<script type="application/json" id="data">{data}</script>
<script>
const d=JSON.parse(document.getElementById("data").textContent),s=document.getElementById("g"),w=innerWidth,h=innerHeight,at={{}};
const el=(n,a,t)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",n);for(const k in a)e.setAttribute(k,a[k]);if(t)e.textContent=t;s.appendChild(e);}};
d.nodes.forEach((n,i)=>{{const r=2*Math.PI*i/d.nodes.length;at[n.id]=[w/2+Math.cos(r)*w*.4,h/2+Math.sin(r)*h*.4];}});
d.links.forEach(l=>{{const a=at[l.source],b=at[l.target];el("line",{{x1:a[0],y1:a[1],x2:b[0],y2:b[1]}});el("text",{{x:(a[0]+b[0])/2,y:(a[1]+b[1])/2,"font-size":10}},l.label);}});
d.nodes.forEach(n=>{{const p=at[n.id];el("circle",{{cx:p[0],cy:p[1],r:5}});el("text",{{x:p[0]+8,y:p[1]+4}},n.id);}});
</script>
"""


LIGHT, DARK = {"back": "#fff", "dot": "#357", "ink": "#222"}, {"back": "#181a1f", "dot": "#7ac", "ink": "#ddd"}
_DATA = re.compile(r'<script type="application/json" id="data">(.*?)</script>', re.S)


def page(title: str, data: dict, dark: bool = False) -> str:
    text = json.dumps(data).replace("<", "\\u003c").replace(">", "\\u003e")
    return PAGE.format(title=html.escape(title), data=text, **(DARK if dark else LIGHT))


def _path(graph, name: str) -> str:
    """Where a view is kept; only the last part of its name counts."""
    last = name.replace("\\", "/").rsplit("/", 1)[-1]
    return f"{graph.config.root.rstrip('/')}/{graph.config.views}/{last}.html"


def saved(graph) -> list[str]:
    at = f"{graph.config.root.rstrip('/')}/{graph.config.views}"
    return [f.removesuffix(".html") for f in Files(graph.spark).names(at, folders=False) if f.endswith(".html")]


class View:
    """A page of a traversal's graph, kept beside the graphs."""

    def __init__(self, files: Files, path: str, text: str):
        self.files, self.path, self.html = files, path, text

    @classmethod
    def of(cls, graph, name: str, persist: bool = True) -> View:
        t = graph._at()
        links = t.graph_links().limit(MOST_LINKS + 1).count()
        if links > MOST_LINKS:
            raise ValueError(f"a view shows at most {MOST_LINKS} links; use limit()")
        view = cls(Files(graph.spark), _path(graph, name), page(name, t.graph()))
        return view.persist() if persist else view

    @classmethod
    def load(cls, graph, name: str) -> View:
        files, path = Files(graph.spark), _path(graph, name)
        text = files.read_text(path)
        if text is None:
            raise FileNotFoundError(path)
        return cls(files, path, text)

    def persist(self) -> View:
        self.files.write_text(self.path, self.html)
        return self

    @property
    def data(self) -> dict:
        """The page's nodes and links."""
        return json.loads(_DATA.search(self.html)[1])

    def render(self, height: int = 500, width: int = 700, dark: bool = False) -> str:
        """The page inside a frame, for notebooks."""
        text = page(html.unescape(re.search("<title>(.*?)</title>", self.html, re.S)[1]), self.data, dark) if dark else self.html
        return f'<iframe srcdoc="{html.escape(text)}" width="{int(width)}" height="{int(height)}" frameborder="0"></iframe>'

    def show(self, height: int = 500, width: int = 700, dark: bool = False) -> str:
        """Shows the page in a notebook, if there is one, and returns its frame."""
        frame = self.render(height, width, dark)
        try:
            from IPython.display import HTML, display
        except ImportError:
            return frame
        display(HTML(frame))
        return frame

    def browse(self) -> View:
        """Opens a copy of the page in the browser of the driver's machine."""
        with tempfile.NamedTemporaryFile("w", suffix=".html", delete=False, encoding="utf-8") as f:
            f.write(self.html)
        webbrowser.open(f"file://{f.name}")
        return self

    def __str__(self) -> str:
        return self.path
