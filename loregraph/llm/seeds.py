"""Seed texts, written for this library, from which the language states are trained.

Everyday remarks of programmers in nine languages, and lines of code and tool noise. They are the only
training data of ``loregraph.llm.language``: no corpus and no download is involved.
"""

PROSE = {
    "en": """This function is called before the data has been loaded. We should not do that here, because the result would be wrong. Please check whether the value is still needed and remove it otherwise.
Do not change the order of these lines, it matters for the tests. The old behaviour is kept for now so that existing users are not affected. Nobody knows why this number was chosen, but it works.
If the server does not answer, we try again after a short time. The cache has to be emptied when the user logs out. This is much slower than it looks and someone should rewrite it soon.
Remember to close the file after reading it. There must be a better way to do this, but we have no time. Only the first error is written to the log, all others are ignored.
It may be empty when two people edit the same record at once. Wait until the service is ready, unless it was started earlier. Every item keeps its position even though the list is sorted. Ask the team first before you touch this part.
The name comes from an older version of the program. It is rounded on purpose. This branch only runs while the job is still active. A second pass is necessary here since the argument is modified. We have to wait for the answer as long as nothing has an owner.
I think that this limit is too low for most of our customers. They were moved to their own module last year. What happens if both are missing? You can find more about it in the manual. That would break the build, so leave it alone.
Never use this in production. Should be moved somewhere else later. Listeners stay registered until the page is closed. Counts twice otherwise. Rarely used, and does not check its input. Used to work around a bug in the browser which has been fixed by now.
See whether we can go away from this after the release. It would be nice to have a test for it too. The method returns nothing, just sets the flag and depends on the others.
The report weighs more than we had thought, so it is split before it is sent. Whoever changes the settings must start the program anew. Since last week both machines share one disk, which is why the first run takes longer. You may skip this step if the table has no rows yet.""",
    "de": """Diese Funktion wird aufgerufen, bevor die Daten geladen sind. Das sollten wir hier nicht tun, weil das Ergebnis sonst falsch wäre. Bitte prüfen, ob der Wert noch gebraucht wird, und ihn sonst entfernen.
Die Reihenfolge dieser Zeilen nicht ändern, sie ist für die Tests wichtig. Das alte Verhalten bleibt vorerst erhalten, damit bestehende Benutzer nicht betroffen sind. Niemand weiß, warum diese Zahl gewählt wurde, aber sie funktioniert.
Wenn der Server nicht antwortet, versuchen wir es nach kurzer Zeit noch einmal. Der Zwischenspeicher muss geleert werden, sobald sich der Benutzer abmeldet. Das ist viel langsamer, als es aussieht, und jemand müsste es bald neu schreiben.
Nicht vergessen, die Datei nach dem Lesen zu schließen. Es gibt bestimmt einen besseren Weg, aber uns fehlt die Zeit. Nur der erste Fehler wird protokolliert, alle anderen werden übergangen.
Hier müssen wir noch etwas warten, bis der Dienst bereit ist. Der Eintrag kann leer sein, falls zwei Leute gleichzeitig speichern. Dieser Zweig läuft nur, wenn es einen alten Client gibt. Ich glaube, dass diese Grenze zu niedrig ist.
Den alten Namen behalten wir, da er sonst doppelt gezählt wird. Diese Prüfung ist nötig und darf nicht gelöscht werden. Was passiert, wenn beide fehlen? Man könnte das später an eine andere Stelle verschieben. Achtung, die Funktion verändert ihr Argument.
Vor dem Lesen der Daten ist ein zweiter Durchlauf erforderlich. Das wurde für eine ältere Fassung des Programms gebaut und wird kaum noch benutzt. Siehe auch die Beschreibung im Handbuch. Wir brauchen dafür noch einen Test.
Der Bericht ist größer, als wir gedacht hatten, deshalb wird er vor dem Versand geteilt. Wer die Einstellungen ändert, muss das Programm neu starten. Seit letzter Woche teilen sich beide Rechner eine Platte, daher dauert der erste Lauf länger. Diesen Schritt kann man auslassen, solange die Tabelle noch keine Zeilen hat.""",
    "fr": """Cette fonction est appelée avant que les données soient chargées. Il ne faut pas faire cela ici, parce que le résultat serait faux. Vérifier si la valeur est encore nécessaire, sinon la supprimer.
Ne pas changer l'ordre de ces lignes, il est important pour les tests. L'ancien comportement est gardé pour le moment afin que les utilisateurs ne soient pas gênés. Personne ne sait pourquoi ce nombre a été choisi, mais il marche.
Si le serveur ne répond pas, nous essayons encore une fois un peu plus tard. Les anciennes clés doivent être jetées dès que la session se termine. C'est beaucoup plus lent que prévu et quelqu'un devrait bientôt le réécrire.
N'oubliez pas de fermer le fichier après la lecture. Il y a sûrement une meilleure façon, mais le temps nous manque. Seule la première erreur est écrite dans le journal, toutes les autres sont ignorées.
Il faut attendre que le service soit prêt. Cette partie peut être vide lorsque deux personnes modifient la même chose. Cette branche ne sert que rarement, car la liste est déjà triée. Je pense que cette limite est trop basse pour la plupart des clients.
On garde le vieux nom jusqu'à la prochaine version. Sinon le total serait trop grand d'une unité. Que se passe-t-il si les deux manquent? Voir aussi la description dans le manuel. La méthode modifie son argument, donc ne pas l'utiliser ailleurs.
Avant de lire ces valeurs, il faudrait un deuxième passage. Elle a été écrite pour une ancienne version du programme et n'est presque plus utilisée. Nous avons encore besoin d'un test pour cela.
Le rapport pèse plus que ce que nous avions pensé, c'est pourquoi il est coupé avant d'être envoyé. Celui qui change les réglages doit relancer le programme. Depuis la semaine dernière les deux machines partagent un disque, ce qui rend le premier passage plus long. On peut sauter cette étape tant que le tableau ne contient aucune ligne. Le mot de passe devra être changé avant de quitter le bureau, de peur qu'un voisin ne le lise.""",
    "es": """Esta función se llama antes de que los datos estén cargados. Aquí no hay que hacer eso, porque el resultado sería falso. Comprobar si el valor todavía hace falta y, si no, quitarlo.
No cambiar el orden de estas líneas, es importante para las pruebas. El comportamiento antiguo se mantiene por ahora para que los usuarios no noten nada. Nadie sabe por qué se eligió este número, pero funciona.
Si el servidor no responde, lo intentamos otra vez un poco más tarde. Conviene tirar las claves viejas en cuanto termina la sesión. Tarda demasiado tiempo y alguien debería escribirlo de nuevo muy pronto.
No olvidar cerrar el archivo después de leerlo. Seguramente hay una forma mejor, pero no tenemos tiempo. Solo el primer error se escribe en el registro, todos los demás se ignoran.
Hay que esperar hasta que el servicio esté listo. Esta parte puede estar vacía cuando dos personas modifican la misma cosa. Esta rama solo se usa a veces, ya que la lista está ordenada. Creo que este límite es demasiado bajo para la mayoría de los clientes.
Guardamos el nombre viejo hasta la próxima versión. Si no, la línea se cuenta dos veces. ¿Qué pasa si faltan los dos? Ver también la descripción en el manual. El método modifica su argumento, así que no usarlo en otro sitio.
Antes de leer estos valores habría que hacer una segunda pasada. Se escribió para una versión antigua del programa y casi ya no se utiliza. Todavía necesitamos una prueba para ello. Habría que mover esta parte a otro lugar.
El informe pesa más de lo que habíamos pensado, por eso se parte antes de enviarlo. Quien cambie los ajustes debe arrancar el programa de nuevo. Desde la semana pasada las dos máquinas comparten un disco, y por lo tanto la primera vuelta es más larga. Se puede saltar este paso mientras la tabla no tenga filas. Parece mentira, pero es lo más sencillo de todo lo que hemos probado; de lo contrario habría que empezar desde el principio.""",
    "pt": """Esta função é chamada antes de os dados serem carregados. Não devemos fazer isso aqui, porque o resultado ficaria errado. Verificar se o valor ainda é necessário e, se não for, remover.
Não mudar a ordem destas linhas, ela é importante para os testes. O comportamento antigo é mantido por enquanto para que os usuários não percebam nada. Ninguém sabe por que este número foi escolhido, mas funciona.
Se o servidor não responder, tentamos outra vez um pouco mais tarde. Convém deitar fora as chaves velhas assim que a sessão termina. Isto é muito mais lento do que parece e alguém deveria reescrever em breve.
Não esquecer de fechar o arquivo depois de ler. Com certeza há uma maneira melhor, mas não temos tempo. Só o primeiro erro é escrito no registo, todos os outros são ignorados.
Temos de esperar até que o serviço esteja pronto. Esta parte pode estar vazia quando duas pessoas alteram a mesma coisa. Este ramo só é usado às vezes, já que a lista está ordenada. Acho que este limite é baixo demais para a maioria dos clientes.
Guardamos o nome velho até a próxima versão. Caso contrário o total fica grande demais. O que acontece se os dois faltarem? Ver também a descrição no manual. O método altera o seu argumento, então não usar em outro lugar.
Antes de ler esses valores seria bom fazer uma segunda passagem. Foi escrita para uma versão antiga do programa e quase não é mais executada. Ainda precisamos de um teste para isso. Os dados vêm de um sistema que não temos.
O relatório pesa mais do que tínhamos pensado, por isso é partido antes de ser enviado. Quem mudar as definições tem de arrancar o programa de novo. Desde a semana passada as duas máquinas partilham um disco, e portanto a primeira volta é mais longa. Pode-se saltar este passo enquanto a tabela não tiver linhas. Não parece, mas é a coisa mais simples de tudo o que já tentámos.""",
    "pl": """Ta funkcja jest wywoływana, zanim dane zostaną wczytane. Nie powinniśmy tego tutaj robić, ponieważ wynik byłby błędny. Proszę sprawdzić, czy wartość jest jeszcze potrzebna, a jeśli nie, usunąć ją.
Nie zmieniać kolejności tych wierszy, jest ważna dla testów. Stare zachowanie zostaje na razie, żeby użytkownicy niczego nie zauważyli. Nikt nie wie, dlaczego wybrano tę liczbę, ale działa.
Jeśli serwer nie odpowie, spróbujemy jeszcze raz trochę później. Pamięć podręczna musi być wyczyszczona, kiedy użytkownik się wyloguje. To jest dużo wolniejsze, niż się wydaje, i ktoś powinien to wkrótce przepisać.
Nie zapomnieć zamknąć pliku po przeczytaniu. Na pewno jest lepszy sposób, ale nie mamy czasu. Tylko pierwszy błąd jest zapisywany w dzienniku, wszystkie inne są pomijane.
Trzeba tu poczekać, aż usługa będzie gotowa. Ta część może być pusta, gdy dwie osoby zmieniają to samo. Ta gałąź jest używana tylko czasami, bo lista jest już posortowana. Myślę, że ta granica jest za niska dla większości klientów.
Zostawić starą nazwę do następnej wersji. W przeciwnym razie wiersz zostanie policzony dwa razy. Co się stanie, jeśli brakuje obu? Zobacz też opis w podręczniku. Metoda zmienia swój argument, więc nie używać jej gdzie indziej.
Przed odczytem tych wartości należałoby zrobić drugie przejście. Powstała dla starszej wersji programu i prawie nie jest już używana. Dane pochodzą od starego klienta. Potrzebujemy do tego jeszcze testu.
Raport waży więcej, niż sądziliśmy, dlatego dzielimy go przed wysłaniem. Kto zmieni ustawienia, musi uruchomić program od nowa. Od zeszłego tygodnia obie maszyny mają wspólny dysk, więc pierwszy przebieg trwa dłużej. Ten krok można pominąć, dopóki tabela nie ma wierszy.""",
    "ru": """Эта функция вызывается до того, как данные загружены. Здесь так делать нельзя, потому что результат будет неверным. Надо проверить, нужно ли ещё это значение, и удалить его, если нет.
Не менять порядок этих строк, он важен для тестов. Старое поведение пока остаётся, чтобы пользователи ничего не заметили. Никто не знает, почему было выбрано это число, но оно работает.
Если сервер не ответит, попробуем ещё раз немного позже. Кэш нужно очистить, когда пользователь выходит. Это намного медленнее, чем кажется, и кто-то должен скоро это переписать.
Не забыть закрыть файл после чтения. Наверняка есть способ лучше, но времени нет. Только первая ошибка пишется в журнал, все остальные пропускаются.
Нужно подождать, пока сервис не будет готов. Эта часть может быть пустой, если двое изменяют одно и то же. Сюда программа попадает нечасто, потому что порядок почти всегда верный. Думаю, этот предел слишком мал для большинства клиентов.
Отчёт весит больше, чем мы думали, поэтому перед отправкой его делят. Кто меняет настройки, должен запустить программу заново. С прошлой недели у обеих машин общий диск, и первый проход идёт дольше. Этот шаг можно пропустить, пока в таблице нет строк.""",
    "zh": """这个函数在数据加载之前被调用。这里不应该这样做，因为结果会是错误的。请检查这个值是否还需要，否则把它删除。
不要改变这些行的顺序，这对测试很重要。暂时保留旧的行为，这样用户不会受到影响。没有人知道为什么选择这个数字，但是它可以工作。
如果服务器没有返回，我们稍后再试一次。用户退出的时候必须清空缓存。这比看起来慢得多，以后应该有人重写。
读取之后不要忘记关闭文件。只有第一个错误会写入日志，其他的都被忽略。需要等待直到服务准备好。两个人同时修改的时候可能为空。这个分支很少使用，因为列表已经排序。
报告比我们想的要大，所以发送之前要先分开。改了设置的人必须重新启动程序。上个星期开始两台机器共用一个硬盘，第一次运行要久一点。表里还没有数据的时候可以跳过这一步。""",
    "ja": """この関数はデータが読み込まれる前に呼ばれます。結果が間違ってしまうので、ここではそうしないでください。値がまだ必要かどうかを確認し、不要なら削除すること。
これらの行の順番は変えないこと、テストにとって大事です。利用者に影響がないように、とりあえず古い動作を残しています。なぜこの数字が選ばれたのかは誰も知りませんが、動いています。
サーバーが応答しない場合は、少し後でもう一度試します。ユーザーがログアウトしたときはキャッシュを消す必要があります。見た目よりずっと遅いので、あとで誰かが書き直したほうがいい。
読んだ後でファイルを閉じるのを忘れないように。最初のエラーだけがログに書かれ、ほかは無視されます。サービスの準備ができるまで待つ。二人が同時に変更すると空になることがあるため注意。
報告書は思ったより大きいので、送る前に分けます。設定を変えた人はプログラムを起動し直してください。先週から二台の機械が同じディスクを使っているため、最初の処理は長くかかります。表に行がないうちは、この手順を飛ばしても構いません。""",
}

CODE = """const result = await fetchItems(ctx.user, { limit: 10 });
if (ready && !done) return;
if (list.length > 0) { return null; }
import { readFile, writeFile } from './files';
import type { Options } from '../types/options';
export default function main(argv: string[]): void {
return value ?? fallback;
return items.map((x) => x.id);
let total = count * 4 + offset - 1;
items[3].size++
this.state.open = false;
for (const entry of entries) { push(entry); }
while (i < n) { i += 2; }
switch (kind) { case 'a': break; default: throw err; }
console.log(user.name)
console.error("failed", err);
throw new Error("bad");
logger.warn("x", ctx);
notify(`y`);
const label = "z";
module.exports = { a, b };
try { run(); } catch (e) { /* empty */ }
type Pair<K, V> = { key: K; value: V };
<Item width={3} onClick={open} />
<div class="box"></div>
<p title="t" />
<img src="a.png" alt="" />
eslint-disable-next-line no-unused-vars
eslint-disable no-console
prettier-ignore
@ts-ignore
@ts-expect-error
@ts-nocheck
istanbul ignore next
noinspection JSUnusedGlobalSymbols
#region helpers
#endregion
https://www.example.org/docs/guide/42
http://localhost:8080/api/v2/items?id=7
v1.2.3
0x3fa9c04b
ABC-1234
PROJ-77
#4521
=============================
-----------------------------
*****************************
#############################
d41d8cd98f00b204e9800998ecf8427e
SELECT id FROM users WHERE age > 3;
npm run build && node dist/index.js
await queue.push(job, { retry: true })
const { a, b } = options;
openDoor(key)
state.value = null
rows[0].cells--
function add(a, b) { return a + b; }
export const MAX = 50;
else if (typeof x === 'string') {
async () => { await next(); }
new Map<string, number>()
assert.equal(actual, expected);
"""
